"""Secret and license scans, HTML extraction: against plain Python, planted cases, edge cases."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import html
import io
import random
import re
import tarfile
import urllib.parse
import zlib

import pytest
import zstandard
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ambercol.llm import html_extract, license_scan, secret_scan

from .conftest import TEXT_WORD, lower


def base_spans(text):
    assign = re.compile(r'(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_secrets_of_all_documents(small):
    got = {r.doc_id: r for r in secret_scan.secret_digests(small).collect()}
    assert len(got) == small.count()
    for r in small.collect():
        spans = base_spans(r.text)
        line = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert got[r.doc_id].n_hex == sum(k == 2 for _, k, _ in spans)
        assert set(filter(None, line.split(","))) <= set(got[r.doc_id].spans.split(","))


SECRET = "password: correct-horse-9"


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: urllib.parse.quote(s), lambda s: urllib.parse.quote(urllib.parse.quote(s)), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s), lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(zlib.compress(bz2.compress(s.encode()))).decode(), lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
        lambda s: urllib.parse.quote(base64.b64encode(urllib.parse.quote(s).encode()).decode()),
    ],
)
def test_wrapped_secrets_map_back(wrap):
    inner = wrap(SECRET)
    text = f"é😀 before {inner} after"
    base, spans, folded = secret_scan.scan(text)
    hidden = [(a, b) for a, k, b, d in spans if k == 0 and d > 0]
    assert hidden and not folded
    a, b = hidden[-1]
    assert text[a:b].strip("=") in inner.strip("=") or inner in text[a:b]
    assert base == base_spans(text)


def test_cycles_end_and_bombs_stay_folded():
    assert secret_scan.scan("%25" * 50 + "41")[2] == 0
    bomb = base64.b64encode(zlib.compress(b"a" * 100_000)).decode()
    assert secret_scan.scan(bomb, most=1000)[2] == 1
    assert secret_scan.scan(bomb)[2] == 0


def test_prose_has_no_hidden_secrets(small):
    for r in secret_scan.scan_secrets(small).collect():
        assert all(s.depth == 0 for s in r.spans)


def test_licenses_of_all_documents(small):
    got = {r.doc_id: r for r in license_scan.license_digests(small).collect()}
    for r in small.collect():
        words = TEXT_WORD.findall(lower(r.text))
        starts, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    starts.append(k)
                    labels.add(label)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.base_labels) == (len(words), len(starts), ",".join(sorted(labels)))
        assert (g.first_word, g.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert labels <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1


@pytest.mark.parametrize(
    "text,label",
    [
        ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"), ("Licensed under the GNU Lesser General Public License, version 2.1", "lgpl-2.1"), ("released under the Mozilla Public License 2.0", "mpl-2"), ("CC BY-NC-SA 4.0", "cc-by-nc-sa"),
        ("see https://creativecommons.org/licenses/by-nd/4.0/", "cc-by-nd"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("Distributed under the Boost Software License", "boost"), ("under the BSD 3-Clause License", "bsd-3-clause"), ("dedicated to the public domain", "public-domain"), ("All rights reserved.", "proprietary"),
    ],
)
def test_license_rules(text, label):
    assert label in {d[2] for d in license_scan.scan(text)[1]}


def test_a_longer_license_name_suppresses_what_lies_within():
    labels = {d[2] for d in license_scan.scan("licensed under the GNU General Public License version 3")[1]}
    assert labels == {"gpl-3"}
    assert {d[2] for d in license_scan.scan("CC BY-SA 4.0")[1]} == {"cc-by-sa"}
    assert license_scan.scan("the driver's license of the clerk")[1] == []
    assert len(license_scan.rules()) > 200


@pytest.mark.filterwarnings("ignore")
def test_a_text_made_from_each_rule_is_found():
    made = {}

    @settings(max_examples=4, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.data())
    def draw(data):
        for i, rule in enumerate(license_scan.rules()):
            made.setdefault(i, set()).add(data.draw(st.from_regex(rule.source, fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyz0123456789 ")))

    draw()
    assert len(license_scan.rules()) > 200
    for i, rule in enumerate(license_scan.rules()):
        assert rule.gate and made[i]
        for text in made[i]:
            text = " ".join(text.split())
            line = f" some words {text} ".encode()
            if rule.pattern.search(line):
                assert any(r is rule for r in license_scan.gated(line)), (rule.source, text)
                assert license_scan.scan(f"Some words: {text}.")[1]
    assert {x[2] for x in license_scan.scan("see www.wtfpl.net for it")[1]} == {"wtfpl"}


def test_words_are_counted_right_on_long_texts():
    text = "word, " * 50_000 + "under the MIT license. " * 3000
    n, found = license_scan.scan(text)
    assert n == 62_000 and [x[0] for x in found if x[4]] == [50_000 + 4 * i for i in range(3000)]


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        article = re.sub(r"</?\Z|<[^>]*\Z", "", article)
        blocks = (re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_held_out_pages_are_labelled_well():
    model = html_extract.default_model()
    right = total = 0
    for page in html_extract.labelled_pages(100, seed=99):
        nodes = html_extract.parse(page)
        html_extract.observe(nodes)
        labels = []
        for n in nodes:
            labels.append(n.label == "content" if n.label else labels[n.parent] if n.parent >= 0 else False)
        for n, p, label in zip(nodes, model.marginals(nodes), labels):
            if n.tag == "#" and n.text.strip():
                total += 1
                right += (p >= 0.5) == label
    assert right / total > 0.93


def test_marginals_are_those_of_enumeration():
    """Sum-product against the sum over all labellings of a small tree."""
    import itertools
    import math

    model = html_extract.default_model()
    nodes = html_extract.parse('<nav><a href="x">go</a></nav><p>Some words, here.</p>')
    html_extract.observe(nodes)
    kinds = [html_extract.group(n) for n in nodes]
    weight, total = [0.0] * len(nodes), 0.0
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        score = model.prior[labels[0]]
        for k, n in enumerate(nodes):
            score += sum(model.node.get((kinds[k], f), (0, 0))[labels[k]] for f in n.features)
            if k:
                score += model.edge[kinds[k]][labels[n.parent]][labels[k]]
        p = math.exp(score)
        total += p
        for k, y in enumerate(labels):
            weight[k] += y * p
    assert model.marginals(nodes) == pytest.approx([w / total for w in weight])


@pytest.mark.parametrize("page", ["", "<", "</", "plain", "<p", "<div>" * 5000, "<p>a</b></p></div>b", "<script>never closed", "<!-- never closed", "<table><td>a<td>b", "&am", "<a href='x>y</a>", "\x00<p>\x00"])
def test_broken_pages_are_borne(page):
    html_extract.extract(page)


def test_hidden_parts_and_entities():
    page = "<html><body><header>top</header><div class='cookie'>we use cookies</div><article><h1>Title</h1><p>One &amp; two&nbsp;\n three.<br>Four, five &#x41;.</p><script>x</script><p>Second one, with words.</p><form>Sign up now</form></article><div id='comments'><p>First, I say this!</p></div><footer>&copy; me</footer></body></html>"
    assert html_extract.extract(page) == "Title\n\nOne & two three. Four, five A.\n\nSecond one, with words."


@pytest.mark.parametrize("attribute", ['title="it was hidden from view"', 'data-hidden="false"', "data-x='class=sidebar hidden'", 'aria-hidden="false"', "title=hidden-gem", 'data-id="comments" x-role=navigation'])
def test_what_only_looks_like_an_attribute_hides_nothing(attribute):
    body = "One two three, four five six. Seven eight, nine ten."
    assert html_extract.extract(f"<nav><a href=x>menu</a></nav><article {attribute}><h1>Title</h1><p {attribute}>{body}</p></article>") == f"Title\n\n{body}"
    assert html_extract.extract(f"<article><h1>Title</h1><p hidden>{body}</p><p HIDDEN='' {attribute}>{body}</p><p aria-hidden = true>{body}</p><p>{body}</p></article>") == f"Title\n\n{body}"


def test_edge_rows(edge):
    n = edge.count()
    assert secret_scan.secret_digests(edge).count() == license_scan.license_digests(edge).count() == n
    pages = edge.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "id", "h")
    rows = html_extract.extract_pages(pages).collect()
    assert len(rows) == n and all(r.text is not None for r in rows)
    none = edge.limit(0)
    assert secret_scan.secret_digests(none).count() == license_scan.license_digests(none).count() == html_extract.extract_pages(pages.limit(0)).count() == 0
    found = {r.doc_id: r.spans for r in secret_scan.secret_digests(edge).collect()}
    assert found[7] == "assign:0:24,access:25:47" and found[2] == ""


def test_random_texts_never_fail():
    r = random.Random(11)
    parts = ["%41", "%C3%A9", "%", "\\u0041", "\\ud83d\\ude00", "\\ud83d", "&#65;", "&#0;", "token=abcdef", "AKIA" + "Z" * 20, "a" * 30, "=", " ", "\n", "YWJjZGVmZ2hpamtsbW5vcA==", "é"]
    for _ in range(500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        base, spans, _ = secret_scan.scan(text)
        assert base == base_spans(text)
        assert all(0 <= a < b <= len(text) for a, _, b, _ in spans)


def test_an_end_tag_closes_its_element_at_any_depth():
    nodes = html_extract.parse("<article>" + "<font>x" * 3000 + "</article><p>after</p>")
    after = next(n for n in nodes if n.text == "after")
    assert nodes[after.parent].tag == "p" and nodes[nodes[after.parent].parent].tag == "html"


def _lines(data, width=76, end="\n"):
    x = base64.b64encode(data).decode()
    return end.join(x[i : i + width] for i in range(0, len(x), width))


def _tar(name, data):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    return out.getvalue()


_NOISE = bytes(random.Random(4).randrange(256) for _ in range(300))


@pytest.mark.parametrize(
    "inner",
    [
        base64.b64encode(SECRET.encode("utf-16-le")).decode(), base64.b64encode(SECRET.encode("utf-16-be")).decode(), base64.b64encode(_tar(".env", SECRET.encode())).decode(), base64.b64encode(b"\xff\x01" + SECRET.encode() + b"\xfe").decode(),
        _lines(zlib.compress(_NOISE + SECRET.encode())), "note\n" + _lines(gzip.compress(_NOISE + SECRET.encode()), 64, "\r\n  "), _lines(b"x" * 50 + SECRET.encode() + b"y" * 90, 70),
        *("path/to/files"[:n] + base64.b64encode(SECRET.encode()).decode() for n in (1, 2, 3, 5, 13)), "x/" + base64.b64encode(gzip.compress(SECRET.encode())).decode(),
    ],
)
def test_bytes_that_are_no_text_and_wrapped_runs_are_scanned(inner):
    _, spans, folded = secret_scan.scan(f"before: {inner} after")
    assert any(k == 0 and d > 0 for _, k, _, d in spans) and not folded


def _deep(data, n):
    for i in range(n):
        data = (gzip.compress, bz2.compress, zlib.compress, zstandard.compress)[i % 4](data)
    return data


@pytest.mark.parametrize(
    "data",
    [
        _deep(SECRET.encode(), 20), gzip.compress(b"a") + gzip.compress(SECRET.encode()), bz2.compress(b"a") + bz2.compress(SECRET.encode()), zstandard.compress(b"a") + zstandard.compress(SECRET.encode()), zlib.compress(b"a") + zlib.compress(SECRET.encode()),
        gzip.compress(SECRET[:12].encode()) + bz2.compress(SECRET[12:].encode()), b"head of a file" + gzip.compress(b"a") + b"\0" * 9 + zstandard.compress(SECRET.encode()),
    ],
)
def test_streams_are_opened_to_any_depth_and_all_members(data):
    _, spans, folded = secret_scan.scan(base64.b64encode(data).decode())
    assert any(k == 0 and d > 0 for _, k, _, d in spans) and not folded
