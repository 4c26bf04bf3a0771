"""The signature rules of the licence scan, as text.

Rules match a text's lower-cased words joined by single spaces, so "CC BY-NC 4.0" reads
``cc by nc 4 0``. Each rule has a label, a priority, a weight (how sure a match is) and an
anchor: a string that every match contains, by which rules are chosen.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    weight: float
    anchor: str
    pattern: str


#: Phrases that always count, whatever else is found: (words, label). Fixed values.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_OR_LATER = r"(?: or(?: any)? later(?: version)?| or newer)?"


def _v(number: str) -> str:
    """A version as licences write it: 3, v3, 3.0, version 3, version 3.0."""
    return rf"(?:version |v )?v?{number}(?: 0)?"


#: label; identifier in licence tags; full name; short form that is unmistakable, or None; all but
#: the label are patterns.
LICENSES = (
    ("mit", "mit", r"mit(?: x11| expat)? license", None),
    ("mit-0", "mit 0", r"mit no attribution license", "mit 0"),
    ("apache-1.1", "apache 1 1", r"apache(?: software)? license (?:version |v )?v?1 1", None),
    ("apache-2", "apache 2 0", rf"apache(?: software)? license {_v('2')}", r"apache 2 0"),
    ("bsd-2-clause", "bsd 2 clause", r"(?:2 clause|simplified|freebsd) bsd license", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause", r"(?:3 clause|new|modified|revised) bsd license", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause", r"(?:4 clause|original|old) bsd license", r"bsd 4 clause"),
    ("0bsd", "0bsd", r"(?:zero clause|0 clause) bsd license", "0bsd"),
    ("isc", "isc", r"isc license", None),
    ("gpl-1", r"gpl 1 0(?: only| or later)?", rf"gnu general public license {_v('1')}{_OR_LATER}", rf"gplv1"),
    ("gpl-2", r"gpl 2 0(?: only| or later)?", rf"gnu general public license {_v('2')}{_OR_LATER}", rf"gpl ?v2"),
    ("gpl-3", r"gpl 3 0(?: only| or later)?", rf"gnu general public license {_v('3')}{_OR_LATER}", rf"gpl ?v3"),
    ("lgpl-2", r"lgpl 2 0(?: only| or later)?", rf"gnu library general public license {_v('2')}{_OR_LATER}", r"lgpl ?v2"),
    ("lgpl-2.1", r"lgpl 2 1(?: only| or later)?", rf"gnu lesser general public license (?:version |v )?v?2 1{_OR_LATER}", r"lgpl ?v2 1"),
    ("lgpl-3", r"lgpl 3 0(?: only| or later)?", rf"gnu lesser general public license {_v('3')}{_OR_LATER}", r"lgpl ?v3"),
    ("agpl-3", r"agpl 3 0(?: only| or later)?", rf"gnu affero general public license {_v('3')}{_OR_LATER}", r"agpl ?v3"),
    ("gfdl-1.3", r"gfdl 1 3(?: only| or later)?", r"gnu free documentation license(?: version)? 1 3", None),
    ("gfdl-1.2", r"gfdl 1 2(?: only| or later)?", r"gnu free documentation license(?: version)? 1 2", None),
    ("mpl-1.1", "mpl 1 1", r"mozilla public license (?:version |v )?v?1 1", r"mpl 1 1"),
    ("mpl-2", "mpl 2 0", rf"mozilla public license {_v('2')}", r"mpl 2 0"),
    ("epl-1", "epl 1 0", rf"eclipse public license {_v('1')}", r"epl 1 0"),
    ("epl-2", "epl 2 0", rf"eclipse public license {_v('2')}", r"epl 2 0"),
    ("edl-1", "edl 1 0", rf"eclipse distribution license {_v('1')}", None),
    ("cddl-1", "cddl 1 0", rf"common development and distribution license {_v('1')}", r"cddl 1 0"),
    ("cpl-1", "cpl 1 0", rf"common public license {_v('1')}", None),
    ("ipl-1", "ipl 1 0", rf"ibm public license {_v('1')}", None),
    ("eupl-1.1", "eupl 1 1", r"european union public licence (?:version |v )?v?1 1", r"eupl 1 1"),
    ("eupl-1.2", "eupl 1 2", r"european union public licence (?:version |v )?v?1 2", r"eupl 1 2"),
    ("cecill-2.1", "cecill 2 1", r"cecill free software license agreement", r"cecill 2 1"),
    ("cecill-b", "cecill b", r"cecill b free software license", None),
    ("artistic-1", "artistic 1 0", rf"artistic license {_v('1')}", None),
    ("artistic-2", "artistic 2 0", rf"artistic license {_v('2')}", None),
    ("boost-1", "bsl 1 0", rf"boost software license {_v('1')}", None),
    ("busl-1.1", "busl 1 1", r"business source license(?: version)? 1 1", r"busl 1 1"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", None),
    ("libpng", "libpng", r"libpng license", None),
    ("unlicense", "unlicense", r"the unlicense", None),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public license", "wtfpl"),
    ("python-2", "psf 2 0", r"python software foundation license", None),
    ("php-3", r"php 3 0 ?1?", r"php license(?: version)? 3", None),
    ("ruby", "ruby", r"ruby license", None),
    ("postgresql", "postgresql", r"postgresql license", None),
    ("ncsa", "ncsa", r"university of illinois ncsa open source license", None),
    ("upl-1", "upl 1 0", rf"universal permissive license {_v('1')}", None),
    ("ms-pl", "ms pl", r"microsoft public license", None),
    ("ms-rl", "ms rl", r"microsoft reciprocal license", None),
    ("osl-3", "osl 3 0", rf"open software license {_v('3')}", None),
    ("afl-3", "afl 3 0", rf"academic free license {_v('3')}", None),
    ("ofl-1.1", "ofl 1 1", r"sil open font license", None),
    ("vim", "vim", r"vim license", None),
    ("x11", "x11", r"x11 license", None),
    ("blueoak-1", "blueoak 1 0 0", r"blue oak model license", None),
    ("mulan-2", "mulanpsl 2 0", rf"mulan permissive software license {_v('2')}", None),
    ("odbl-1", "odbl 1 0", r"open(?: data commons)? database license", "odbl"),
    ("odc-by-1", "odc by 1 0", r"open data commons attribution license", None),
    ("pddl-1", "pddl 1 0", r"public domain dedication and license", None),
    ("sspl-1", "sspl 1 0", r"server side public license", "sspl"),
    ("elastic-2", "elastic 2 0", rf"elastic license {_v('2')}", None),
    ("polyform-nc-1", "polyform noncommercial 1 0 0", r"polyform noncommercial license", None),
    ("openrail-m", "openrail m", r"(?:open rail m|openrail m|responsible ai) license", None),
    ("llama-community", "llama community", r"llama(?: \d+){0,9} community license", None),
    ("cc0", "cc0 1 0", r"creative commons zero", "cc0"),
    ("cc-by", r"cc by [1-4] [0-9]", r"creative commons attribution(?: [1-4] [0-9])?(?: international| unported)? license", r"cc by [1-4] [0-9]"),
    ("cc-by-sa", r"cc by sa [1-4] [0-9]", r"creative commons attribution share ?alike(?: [1-4] [0-9])?(?: international| unported)?(?: license)?", r"cc by sa"),
    ("cc-by-nd", r"cc by nd [1-4] [0-9]", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [0-9])?", r"cc by nd"),
    ("cc-by-nc", r"cc by nc [1-4] [0-9]", r"creative commons attribution non ?commercial(?: [1-4] [0-9])?", r"cc by nc"),
    ("cc-by-nc-sa", r"cc by nc sa [1-4] [0-9]", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [0-9])?", r"cc by nc sa"),
    ("cc-by-nc-nd", r"cc by nc nd [1-4] [0-9]", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [0-9])?", r"cc by nc nd"),
)

#: Sentences of the licences' own texts and notices: label, weight, anchor, pattern.
SENTENCES = (
    ("mit", 0.9, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 0.9, "to use copy modify and", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-3-clause", 0.9, "neither the name of", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", 0.9, "all advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-clause", 0.6, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2", 0.95, "www apache org", r"(?:http|https) www apache org licenses license 2 0"),
    ("apache-2", 0.8, "you may not use this file", r"you may not use this file except in compliance with the license"),
    ("gpl-2", 0.9, "free software foundation", r"(?:gnu general public license as )?published by the free software foundation either version 2 of the license"),
    ("gpl-3", 0.9, "free software foundation", r"(?:gnu general public license as )?published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", 0.9, "free software foundation", r"(?:gnu )?lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3", 0.9, "free software foundation", r"(?:gnu )?lesser general public license as published by the free software foundation either version 3"),
    ("agpl-3", 0.9, "free software foundation", r"(?:gnu )?affero general public license as published by the free software foundation either version 3"),
    ("gpl-2", 0.8, "gpl version", r"(?:gnu )?gpl version 2(?: 0)?(?: only| or later| or any later version)?"),
    ("gpl-3", 0.8, "gpl version", r"(?:gnu )?gpl version 3(?: 0)?(?: only| or later| or any later version)?"),
    ("lgpl-2.1", 0.8, "gpl version", r"(?:gnu )?lgpl version 2 1(?: only| or later| or any later version)?"),
    ("lgpl-3", 0.8, "gpl version", r"(?:gnu )?lgpl version 3(?: 0)?(?: only| or later| or any later version)?"),
    ("agpl-3", 0.8, "gpl version", r"(?:gnu )?agpl version 3(?: 0)?(?: only| or later| or any later version)?"),
    ("mpl-2", 0.95, "mozilla public license", r"subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 0.9, "mozilla org", r"mozilla org mpl 2 0"),
    ("unlicense", 0.95, "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", 0.9, "without any express or implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost-1", 0.9, "boost org license", r"boost org license 1 0 txt"),
    ("cc0", 0.95, "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", 0.95, "creativecommons org", r"creativecommons org licenses by [1-4] [0-9]"),
    ("cc-by-sa", 0.95, "creativecommons org", r"creativecommons org licenses by sa [1-4] [0-9]"),
    ("cc-by-nd", 0.95, "creativecommons org", r"creativecommons org licenses by nd [1-4] [0-9]"),
    ("cc-by-nc", 0.95, "creativecommons org", r"creativecommons org licenses by nc [1-4] [0-9]"),
    ("cc-by-nc-sa", 0.95, "creativecommons org", r"creativecommons org licenses by nc sa [1-4] [0-9]"),
    ("cc-by-nc-nd", 0.95, "creativecommons org", r"creativecommons org licenses by nc nd [1-4] [0-9]"),
    ("wtfpl", 0.95, "you just do what", r"you just do what the fuck you want to"),
    ("ofl-1.1", 0.95, "scripts sil org", r"scripts sil org ofl"),
    ("epl-2", 0.95, "www eclipse org", r"www eclipse org legal epl 2 0"),
    ("epl-1", 0.95, "www eclipse org", r"www eclipse org legal epl v10"),
    ("public-domain", 0.7, "public domain", r"(?:released|placed|dedicated|donated) (?:in|into|to) the public domain"),
    ("proprietary", 0.5, "all rights reserved", r"all rights reserved"),
    ("proprietary", 0.7, "confidential", r"proprietary and confidential|confidential and proprietary"),
)

#: Statements that name a family without a version, or no known licence: label, weight, anchor, pattern.
UNSPECIFIC = (
    ("gpl", 0.6, "general public license", r"gnu general public license"),
    ("lgpl", 0.6, "general public license", r"gnu (?:lesser|library) general public license"),
    ("agpl", 0.6, "general public license", r"gnu affero general public license"),
    ("apache", 0.5, "apache license", r"apache license"),
    ("bsd", 0.5, "bsd license", r"bsd(?: style)? license"),
    ("mpl", 0.5, "mozilla public license", r"mozilla public license"),
    ("epl", 0.5, "eclipse public license", r"eclipse public license"),
    ("creative-commons", 0.4, "creative commons", r"creative commons(?: license)?"),
    ("unknown", 0.2, "licensed under", r"licensed under"),
    ("unknown", 0.2, "released under", r"released under (?:[^ ]+ ){0,4}license"),
)

#: How a text grants a licence before it names it.
_GRANT = r"(?:released|licensed|distributed|available|published|covered|provided)(?: [^ ]+)? under (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?"


def rules() -> list[Rule]:
    """All rules in order of application: a base phrase, tag, sentence, grant, title, short form, unspecific."""
    out = [Rule(label, 1000, 0.95, phrase, phrase) for phrase, label in BASE]
    for label, tag, name, short in LICENSES:
        out.append(Rule(label, 900, 1.0, "spdx license identifier", rf"spdx license identifier {tag}"))
        anchor = "creative commons" if name.startswith("creative") else "licence" if "licence" in name else "license"
        out.append(Rule(label, 700, 0.95, anchor, _GRANT + name))
        out.append(Rule(label, 500, 0.8, anchor, name))
        out.append(Rule(label, 600, 0.9, "licenses", rf"(?:opensource|spdx) org licenses {tag}"))
        if short:
            literal = re.split(r".\?|[\[(\\]", short)[0].strip()
            out.append(Rule(label, 700, 0.95, literal, _GRANT + short))
            out.append(Rule(label, 400, 0.6, literal, short))
    out += [Rule(label, 800, weight, anchor, pattern) for label, weight, anchor, pattern in SENTENCES]
    out += [Rule(label, 100, weight, anchor, pattern) for label, weight, anchor, pattern in UNSPECIFIC]
    return out
