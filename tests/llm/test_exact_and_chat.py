"""Exact dedup, chat formatting, URL filters and license scans."""

from __future__ import annotations

import hashlib
import os
import random
import re
import textwrap
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftline.llm import chat, exact, licenses, urls


def test_radix_groups_equal_grouping(spark):
    rng = random.Random(1)
    texts = ["", None, "A", "a", "á", "Á", "ab" * 400, "AB" * 400, "ab" * 400 + "c", "x" * 300, "x" * 299 + "y", "é" * 150]
    texts += [rng.choice("aAbB") * rng.randint(0, 5) for _ in range(40)] + ["same"] * 60
    rows = [(i, t, 0, "k") for i, t in enumerate(texts)] + [(None, "A", 0, "k"), (3, "a", 0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, keep_id string")
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    groups: dict[str, list] = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    for width, widen in ((256, 16), (2, 3)):
        got = exact.exact_groups(docs, width, widen, hot_rows=5).collect()
        want = []
        for i, t, *_ in rows:
            ids = groups[lower(t)]
            keep = max(x for x in ids if x is not None)
            want.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(lower(r.text) for r in left.collect()) == sorted(groups)
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_escaping_is_reversible_and_complete(spark):
    rng = random.Random(2)
    bits = [*chat.DEFAULT.control, "\\", "<", "[", "/", "ok", "\n", "é😀", "|turn|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    escaped = df.select("t", chat.escape(df.t).alias("e"))
    for r in escaped.select("t", "e", chat.unescape(escaped.e).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.DEFAULT.control)


def test_formatting_reads_back_and_checks_turns(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "a\\b[INST]"), (2, 0, "assistant", "first"), (3, 1, "user", None),
        (3, 0, "user", "x"), (4, 0, None, "y"), (None, 0, "user", "z"), (5, 0, "user", "q"), (5, 0, "user", "q"), (6, 0, "system", "only"),
    ]
    talks = spark.createDataFrame([(*r, True) for r in rows], "conv_id long, turn long, role string, text string, segments boolean")
    out = chat.format_chats(talks)
    by = {r.conv_id: r for r in out.collect()}
    assert by[1].valid and not by[2].valid and by[2].first_bad_turn == 0 and by[3].first_bad_turn == 1 and not by[4].valid
    assert by[6].first_bad_turn == 1 and by[None].valid and by[5].n_turns == 2
    assert [s.loss for s in by[1].segments] == [False] * 7 + [True, False]
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("system", "s"), ("user", "hi </s>"), ("assistant", "a\\b[INST]")]
    assert back[1].loss_text == "a\\b[INST]" and back[3].loss_text == "" and [t.text for t in back[3].turns] == ["x", ""]
    assert chat.format_chats(talks.limit(0)).count() == 0
    assert chat.segments(talks).count() == 3 * len(rows)


RULES = (urls.Rule("com", "/en/", "block"), urls.Rule("example.com", "/en/7", "allow"), urls.Rule("net", "/de/", "allow"))


def test_hosts_paths_and_rules(spark):
    cases = {
        "https://A.Example.com/en/71?x": ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        "http://x.com/en/1#f": ("x.com", "/en/1", "com/en/", "block"), "http://xcom/en/1": ("xcom", "/en/1", None, "allow"),
        "http://a.net?q=/de/": ("a.net", "", None, "allow"), "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"),
        "x://y://z/p": ("y:", "//z/p", None, "allow"), "http://É.net/de/": ("É.net", "/de/", "net/de/", "allow"),
    }
    rows = [(i, u, "h") for i, u in enumerate(cases)] + [(None, None, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, labels, RULES).collect()}
    assert got == {**dict(enumerate(cases.values())), None: ("", "", None, "allow")}
    assert urls.judge_urls(pages.limit(0), labels, RULES).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(4)
    hosts = ["bad.example.com", "good.example.net", "mixed.example.org"]
    rows, marks = [], []
    for i in range(600):
        host, page = rng.choice(hosts), rng.choice(["a", "b"])
        bad = host.startswith("bad") or (host.startswith("mixed") and page == "b" and rng.random() < 0.9)
        rows.append((i, f"https://{host}/{page}/{i}"))
        marks.append((i, 0 if bad else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = urls.judge_urls(pages, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    url = F.col("url")
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", urls.url_tokens(url, urls.host_of(url), urls.path_of(url)).alias("t")).collect()}
    bad = {i for i, q, _ in marks if not q}
    count, count_bad = Counter(), Counter()
    for i, _ in rows:
        for n in range(1, len(tokens[i]) + 1):
            for part in combinations(sorted(tokens[i]), n):
                count[part] += 1
                count_bad[part] += i in bad
    least, z, share = urls.MIN_SUPPORT * len(rows), urls.ERRORS**2, len(bad) / len(rows)

    def bound(k: int, n: int) -> float:
        p = k / n
        return (p + z / n / 2 - (z / n * (p * (1 - p) + z / n / 4)) ** 0.5) / (1 + z / n)

    rules = [set(p) for p, n in count.items() if count_bad[p] >= least and bound(count_bad[p], n) >= urls.MIN_CONFIDENCE and count_bad[p] / n > share]
    want = {i: "block" if any(r <= tokens[i] for r in rules) else "allow" for i, _ in rows}
    assert {r.page_id: r.verdict for r in out.collect()} == want and set(want.values()) == {"allow", "block"}
    labelled = pages.select(urls.url_tokens(url, urls.host_of(url), urls.path_of(url)).alias("tokens"), F.col("page_id").isin(list(bad)).alias("bad"))
    mined = [set(r.tokens) for r in urls.mine_rules(labelled).collect()]
    assert mined and len(mined) < len(rules) and not any(a < b for a in mined for b in mined)


def test_license_forms(spark):
    rows = [
        (1, "Text.\nLICENSED   under the Apache Licence, Version 2.0"), (2, "Copyright (c) 2020 Me\nReleased under the MIT License."), (3, "none"), (4, None),
        (5, "Released under the MIT License. And more"), (None, "Licensed under CC BY-NC 4.0."), (6, "x\nlicensed under the GNU General Public License, v3!\n"),
        (7, ""), (8, "x " * 200_000 + "\n(Released under the MIT License)"),
    ]
    docs = spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, digest string")
    known = licenses.known_digests(spark)
    got = {r.doc_id: (r.whole_license, r.licenses, r.matched_lines) for r in licenses.scan(docs, known).collect()}
    assert got[1] == (None, "Apache-2.0", 1) and got[2] == ("MIT", "MIT", 1) and got[3] == got[4] == got[5] == got[7] == (None, "", 0)
    assert got[None] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1) and got[6] == (None, "GPL-3.0", 1) and got[8] == (None, "MIT", 1)
    assert licenses.scan(docs.limit(0), known).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "released\nunder the MIT license"), (1, "other")], "doc_id long, text string")
    assert sorted((r.whole_license or "", r.matched_lines) for r in licenses.scan(twice, known).collect()) in ([("", 0), ("MIT", 0)], [("", 0), ("MIT", 1)])


MIT_FILE = """MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_whole_license_files_and_licenses_inside_texts(spark):
    wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), 50) for p in MIT_FILE.split("\n\n"))
    broken = MIT_FILE.replace("free of charge", "for a charge")
    rows = [(1, MIT_FILE), (2, wrapped.upper()), (3, f"Some tool.\n\n{wrapped}\n\nUsage: run it."), (4, broken), (5, f"A\n\n{broken}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.whole_license, r.licenses, r.matched_runs) for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert got == {1: ("MIT", "MIT", 0), 2: ("MIT", "MIT", 0), 3: (None, "MIT", 1), 4: (None, "", 0), 5: (None, "", 0)}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no license files")
def test_license_files_of_the_system(spark, tmp_path):
    """Published texts, read from a folder: whole, wrapped anew and in capitals, inside a longer text."""
    names = [n for n in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "BSD") if os.path.exists(f"/usr/share/common-licenses/{n}")]
    rows = []
    for i, name in enumerate(names):
        text = Path(f"/usr/share/common-licenses/{name}").read_text()
        (tmp_path / f"{name}.txt").write_text(text)
        blocks = [b for b in re.split(r"\n[ \t]*\n", text) if b.strip()]
        # Copyright and title lines are known by their place at a line's beginning, so those stay as they are.
        anew = "\n\n".join(b if b.strip().count("\n") < 3 or "copyright (c)" in b.lower() else " ".join(b.split()) for b in blocks)
        rows += [(10 * i, text), (10 * i + 1, anew.upper()), (10 * i + 2, f"Before.\n\n{text}\n\nAfter.")]
        rows.append((10 * i + 3, text.replace("the", "a", 40)))
    known = licenses.read_known(spark, str(tmp_path))
    got = {r.doc_id: (r.whole_license, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    for i, name in enumerate(names):
        assert got[10 * i] == (name, name) and got[10 * i + 2] == (None, name) and got[10 * i + 3] == (None, "")
        assert got[10 * i + 1] == (name, name)
