"""License rules: identifiers, expressions, addresses, bodies and four languages; and sentences that mention none."""

import re

import pytest
from pyspark.sql import functions as F

from tidecurve.llm import licenses

FOUND = {
    "Licensed under MPL-2.0.": "mpl-2.0", "License: EPL-2.0": "epl-2.0", "Licensed under AGPL-3.0": "agpl-3.0", "EUPL-1.2": "eupl-1.2", "licensed under Artistic-2.0": "artistic-2.0", "CC0-1.0": "cc0-1.0",
    "BSD-3-Clause": "bsd-3-clause", "see MPL 2.0 for it": "mpl-2.0", "CC BY 4.0": "cc-by-4.0", "CC-BY-4.0": "cc-by-4.0", "LGPL v2": "lgpl-2.0", "an MIT-licensed tool": "mit", "under the Boost license": "bsl-1.0",
    "the GNU Free Documentation License": "gfdl", "see https://spdx.org/licenses/Apache-2.0.html": "apache-2.0", "University of Illinois/NCSA Open Source License": "ncsa", "License: NCSA": "ncsa", "PHP License 3.01": "php-3.01",
    "W3C Software License": "w3c", "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2.0,mit", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "gpl-2.0", "SPDX-License-Identifier: BSD-2-Clause AND ISC": "bsd-2-clause,isc",
    "License :: OSI Approved :: MIT License": "mit", "License :: OSI Approved :: Mozilla Public License 2.0 (MPL 2.0)": "mpl-2.0",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY': "mit",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES': "bsd",
    "Dieses Programm ist lizenziert unter der MIT-Lizenz.": "mit", "veröffentlicht unter der Apache-2.0": "apache-2.0", "Lizenz: MPL-2.0": "mpl-2.0", "Das Werk ist gemeinfrei.": "public-domain", "Alle Rechte vorbehalten": "proprietary",
    "Ce logiciel est distribué sous licence MIT.": "mit", "publié sous la licence Apache 2.0": "apache-2.0", "Tous droits réservés": "proprietary", "dans le domaine public": "public-domain",
    "Este programa se publica bajo la licencia MIT.": "mit", "bajo licencia GPL 3.0": "gpl-3.0", "Todos los derechos reservados": "proprietary", "con licencia Apache 2.0": "apache-2.0",
    "MS-PL": "ms-pl", "Zope Public License (ZPL) Version 2.1": "zpl-2.1", "CeCILL-B": "cecill-b", "under the same terms as Perl itself": "perl", "BSD 3-Clause": "bsd-3-clause", "GPL-3.0-or-later": "gpl-3.0",
}

CLEAN = [
    "She works at MIT and studies the tides.", "The apache helicopter landed at dawn.", "Version 2.0 of the map was printed.", "Please replace the old simple lamp.", "He has a driving license from 1998.",
    "The artistic director left in 2.0 seconds.", "An eclipse of the moon is due on the 3rd.", "Mozilla is the name of a lizard in the book.", "The license plate read EPL 204.", "I see a boost in sales of 1.0 percent.",
    "Der Zug fährt unter der Brücke durch.", "La rivière passe sous la ville.", "El perro duerme bajo la mesa.", "The general public was invited to the isc meeting.", "Unter der alten Eiche saß ein Mann.", "Il vit con amigos en la ciudad.",
    "The public was released from the hall at 3.0 hours.", "Permission was granted to leave early.", "All the rights and lefts were confused.", "He redistributed the sweets in equal parts.", "Python and ruby are colours of the snake.",
    "Its number is 0.65 and not 3.01.", "Creative people in the commons of the town.", "The wall is covered by ivy.", "Water is provided by the town.", "The book was published by a small press.", "That room is available under request.",
    "Die Stadt liegt unter dem Meeresspiegel.", "zlib and openssl were words on the wall.", "A unicorn has no licence to fly.", "She is licensed to drive.", "This is the end of the user guide.", "MPL is a river in the west.", "The cc of the motor is 125.",
]


def test_mentions_and_clean_sentences(spark):
    filler = [f"{a} {b} {c}." for a in ("The harbour", "A teacher", "Every boat", "My sister", "The old bridge") for b in ("was covered by", "is available to", "was provided with", "has the right to", "was distributed among") for c in ("the people", "seven towns", "snow in 2.0 hours", "a new domain of thought", "the prior owner", "creative minds")]
    clean = CLEAN + filler
    assert len(clean) > 180
    rows = [(i, t) for i, t in enumerate([*FOUND, *clean])]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "labels").collect()}
    missed = {t: got[i] for i, (t, want) in enumerate(FOUND.items()) if not set(want.split(",")) <= set(got[i].split(","))}
    assert not missed
    wrong = {t: got[i] for i, t in rows if i >= len(FOUND) and got[i]}
    assert not wrong


def test_rules_are_reached():
    """Any text that a hand-written rule matches passes the gates of the document and of the rule."""
    for text, want in FOUND.items():
        low = text.translate({ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        hit = [r for r in licenses.rules() if r["label"] in want.split(",") and re.search(r["regex"], low)]
        assert hit and any(g in low for g in licenses.GATES), text
        assert any(all(any(all(w in low for w in phrase.split()) for phrase in phrases) for phrases in r["keywords"]) for r in hit), text
    assert len(licenses.WORDINGS.strip().split("\n")) >= 150


@pytest.mark.parametrize("n", [3000])
def test_long_texts_with_mentions(spark, n):
    text = " ".join(f"word{i % 97}" for i in range(n)) + " Licensed under MPL-2.0. " + " ".join(f"word{i % 89}" for i in range(n))
    got = licenses.scan(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).select("doc_id", "labels", F.size("detections").alias("n")).collect()
    assert {(r["doc_id"], r["labels"], r["n"]) for r in got} == {(1, "mpl-2.0", 1), (2, "", 0), (3, "", 0)}
