import re
from itertools import product
from re import _parser

import pytest

from zonewright.llm import license_scan
from zonewright.llm.license_scan import license_table


def alternatives(parsed):
    """Every text that a parsed regex of fixed words matches."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append(["w" if str(kind) == "CATEGORY" else chr(c) for kind, c in arg])
        elif name == "SUBPATTERN":
            parts.append(alternatives(arg[3]))
        elif name == "BRANCH":
            parts.append([t for branch in arg[1] for t in alternatives(branch)])
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            parts.append(["", *alternatives(arg[2])])
        elif name == "MAX_REPEAT":
            parts.append([one * arg[0] for one in alternatives(arg[2])])
        else:
            raise AssertionError(name)
    return ["".join(p) for p in product(*parts)]


def test_every_match_has_its_keyword_and_a_gate():
    lost = []
    for number, label, keyword, regex, _ in license_scan.rules():
        for text in alternatives(_parser.parse(regex)):
            assert re.fullmatch(regex, text)
            if not any(k in text for k in keyword.split("|")) or not any(g in text for g in (*license_scan.GATES, *license_scan.GATES_OF_TEXTS)):
                lost.append((number, label, text))
    assert lost == []


def test_every_text_signature_is_found_in_its_text(spark):
    texts = [(n, license_scan_text) for n, (_, license_scan_text) in enumerate((label, alternatives(_parser.parse(r))[0]) for label, _, some in license_scan.SIGNATURES for r in some)]
    labels = [label for label, _, some in license_scan.SIGNATURES for _ in some]
    rows = license_table(spark.createDataFrame([(n, f"Here: {t}. And more") for n, t in texts], "doc_id long, text string")).collect()
    assert len(rows) > 100 and [r.doc_id for r in rows if labels[r.doc_id] not in r.labels.split(",")] == []


@pytest.mark.parametrize("spaced", ["released under GPLv3", "terms of GPL 3 hold", "LGPLv3", "AGPLv3", "Apache 2.0", "WTFPL", "Mulan PSL v2", "Creative Commons Zero", "licensed under the Expat License", "X11 License"])
def test_labels_do_not_need_other_words(spark, spaced):
    texts = [spaced, f"{spaced} holds, so whoever has an account submits many licenses"]
    rows = license_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0].labels and rows[0].labels == rows[1].labels
