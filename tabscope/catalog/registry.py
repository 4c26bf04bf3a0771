"""All registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from tabscope.catalog import evaluation, forecasting, modelling, profiling, storage

MODULES = [profiling, storage, evaluation, forecasting, modelling]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in MODULES for name, text in module.ORACLES.items()}
