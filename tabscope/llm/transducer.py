"""Byte-pair encoding as a deterministic transducer, compiled on demand.

A byte-pair encoding is locally checkable: a sequence of tokens is the encoding of its
text exactly if every adjacent pair of tokens is the encoding of the pair's text
(Berglund, Martens and van der Merwe, "Constructing a BPE tokenization DFA", 2024). So
the last token of a prefix's encoding is the one token that ends there and fits the last
token of the prefix before it. A state keeps what later symbols can ask for: the last
token of the prefix read, and for every suffix that a longer token may begin with, the
last token before that suffix and how many tokens fewer it had. Reading a symbol leads to
the next state and emits the change in the number of tokens, which may be negative.

States and transitions are made when a text first needs them and kept; beyond
``max_states`` the compiled part is given up and made anew, which costs time only.
"""

from __future__ import annotations

import json

BEGIN = ""  # the last token of an empty prefix
END = 256  # added to a word's last byte where the vocabulary marks word ends


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Symbols are the characters of a string: bytes as chr(0) to chr(255), and the last byte
    of a word moved up by ``END`` where the vocabulary has a word-end suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], max_states: int = 200_000):
        self.ids = vocab
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.made: dict[str, tuple[int, str, str]] = {}
        for i, (left, right) in enumerate(merges):
            self.made.setdefault(left + right, (i, left, right))
        self._edges: tuple[dict[str, list], dict[str, list]] = {}, {}
        self.longer = {(start := token[:i]): start for token in vocab for i in range(len(token))}
        self.own = {token: token for token in vocab}  # one object for each token, wherever it is kept
        self.max_states = max_states
        self._fits: dict[str, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.step: dict[int, int] = {}  # state << 9 | symbol: next state << 8 | change + 128
        self.last: list[str] = []
        self._open: list[tuple] = []
        self._number: dict[tuple, int] = {}
        self._state(("", BEGIN, 0), BEGIN)

    def _state(self, open_suffixes: tuple, last: str) -> int:
        """open_suffixes: suffix, last token before it, tokens before it less tokens so far; and so on, longest first."""
        number = self._number.setdefault(open_suffixes, len(self.last))
        if number == len(self.last):
            self.last.append(last)
            self._open.append(open_suffixes)
        return number

    def merged(self, symbols: str) -> list[str]:
        """The encoding by the definition: merge the pair of lowest rank, leftmost first, until none is left."""
        parts, rank, none = list(symbols), self.rank, len(self.rank)
        while len(parts) > 1:
            ranks = [rank.get(pair, none) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts that stand at the token's left (0) or right (1) end while it is merged, each
        with the rank of the merge that uses it up."""
        edge = self._edges[side].get(token)
        if edge is None:
            edge, part, until = [], token, float("inf")
            while part is not None:
                edge.append((part, until))
                until, *halves = self.made.get(part, (0, None, None))
                part = halves[side]
            self._edges[side][token] = edge = edge[::-1]
        return edge

    def fits(self, before: str, token: str) -> bool:
        """Whether the two tokens are the encoding of their joined text (``before`` may be empty).

        They are not if, while both are merged, a pair across their border gets its turn:
        before the left part is used up, and not after the right part is, since of equal
        ranks the leftmost pair goes first.
        """
        if not before:
            known = self._fits.get(token)
            if known is None:
                known = self._fits[token] = self.merged(token) == [token]
            return known
        lefts, rights, i, j = self._edge(before, 1), self._edge(token, 0), 0, 0
        while True:
            (left, left_until), (right, right_until) = lefts[i], rights[j]
            turn = self.rank.get((left, right))
            if turn is not None and turn < left_until and turn <= right_until:
                return False
            if left_until <= right_until:
                i += 1
                if i == len(lefts):
                    return True
            else:
                j += 1

    def compile(self, state: int, symbol: str) -> int:
        """The transition for ``symbol``: next state and change in the number of tokens."""
        found, kept = None, []
        parts = iter(self._open[state])
        for suffix, before, fewer in zip(parts, parts, parts):
            grown = suffix + symbol
            if found is None and grown in self.ids and self.fits(before, grown):
                found = self.own[grown], fewer + 1
            if grown in self.longer:
                kept += (self.longer[grown], before, fewer)
        if found is None:
            raise ValueError(f"no token fits at symbol {ord(symbol)}")
        last, change = found
        kept[2::3] = [fewer - change for fewer in kept[2::3]]
        target = self._state((*kept, "", last, 0), last)
        known = self.step[state << 9 | ord(symbol)] = target << 8 | change + 128
        return known

    def _room(self) -> None:
        if len(self.last) > self.max_states:
            self._reset()

    def count(self, symbols: str) -> int:
        """How many tokens the encoding has."""
        self._room()
        step, state, total = self.step, 0, 0
        for symbol in symbols:
            known = step.get(state << 9 | ord(symbol)) or self.compile(state, symbol)
            state = known >> 8
            total += (known & 255) - 128
        return total

    def encode(self, symbols: str) -> list[int]:
        """The token ids: last tokens of the prefixes, followed back from the end."""
        self._room()
        step, last, state, ends = self.step, self.last, 0, []
        for symbol in symbols:
            state = (step.get(state << 9 | ord(symbol)) or self.compile(state, symbol)) >> 8
            ends.append(last[state])
        out, at = [], len(symbols)
        while at:
            token = ends[at - 1]
            out.append(self.ids[token])
            at -= len(token)
        return out[::-1]


def load(path: str, max_states: int = 200_000) -> Transducer:
    """The transducer of a vocabulary file of the tokenizers library with a byte-level BPE model."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ending = model.get("end_of_word_suffix") or ""
    alphabet = _byte_alphabet()

    def symbols(token: str) -> str:
        cut = token[: -len(ending)] if ending and token.endswith(ending) and token != ending else token
        text = "".join(chr(alphabet[c]) for c in cut)
        return text if cut is token else text[:-1] + chr(ord(text[-1]) + END)

    vocab = {}
    for token, number in model["vocab"].items():
        if all(c in alphabet for c in token.removesuffix(ending)):
            vocab.setdefault(symbols(token), number)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Transducer(vocab, [(symbols(a), symbols(b)) for a, b in pairs], max_states)
