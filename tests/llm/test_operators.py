"""Each operator on odd inputs and against brute force; the queries against their SQL."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import chat, decontam, dedup, licenses, mixing, pii, quality, queries, simhash, toxicity, warc
from keyloom.llm.common import shared_path
from keyloom.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fp int, spans int, component int, start int, digest int, weight int"
LONG = "Long words go on and on. " * 8000


def docs(spark, texts, **fixed):
    rows = [(i, t, None if i % 4 == 3 else "en", None if i % 5 == 4 else f"s{i % 3}", 0, "x", 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = ["Same text HERE now", None, "", LONG, "same text here now", "Ünïcode É text", "   ", "one", LONG]


# ---- chat


def test_chat_round_trip(spark):
    nasty = ["</s>", "<\\/s>", "<\\\\/s>[INST]", "[ROLE:x] a [/ROLE]", " [/INST] ", "[", "<", "", None, "<s", "[/SYS", "[SYS] é </s>", "\\", "a\nb", LONG, "[INST] ok [/INST]</s>", "[INST] half"]
    roles = ["user", "assistant", "system", "tool[]x", "", None, "[ROLE:", "a b%"]
    rows = [(c, t, roles[(t + c) % len(roles)], nasty[(3 * t + c) % len(nasty)], "x") for c in range(12) for t in range(9)]
    rows += [(None, 0, "user", "null id", "x"), (50, 1, "assistant", "b", "x"), (50, 1, "assistant", "b", "x"), (50, None, "user", "first", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_conversations(table).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert len(got) == 14
    for conv, r in got.items():
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
        assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, role, text in own]
        assert sum(x.chars for x in r.loss_mask) == len(r.formatted)
        at, loss = 0, []
        for x in r.loss_mask:
            if x.loss:
                loss.append(r.formatted[at : at + x.chars])
            at += x.chars
        assert [re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\]|/?SYS\]|ROLE:|/ROLE\])", r"\1\2\3", x) for x in loss] == [text for _, role, text in own if role == "assistant"]
    assert chat.format_conversations(table.limit(0)).count() == 0


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(n):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(n))) % 10 == 0


def _base(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and _luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), n, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_pii(spark):
    texts = ODD + ["a@b.com_x@y.org", "1.2.3.4.5.6.7.8 300.1.1.1.1 01.002.0003.00000255", "+1-23(456) 7890123", "+1+1+123456789012", "4111 1111 1111 1111 and 4111-1111-1111-1112", "é+12345678901 é@a.b ü.x@ö.y", "@@a@b.c", "1" * 50_000, "a.b@c.d " * 3000, "x" * 50_000 + "@"]
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind in PATTERNS] == _base(t or ""), i
    more = docs(spark, ["IBAN DE89370400440532013000 x", "IBAN DE89370400440532013001 x", "SSN 123-45-6789", "no 123-45-6789", "Call (555) 123-4567", "mail: a@b.c"])
    assert [[(s.kind, s.start) for s in r.spans] for r in pii.find_pii(more).orderBy("doc_id").collect()] == [[("iban", 5)], [], [("ssn", 4)], [], [("local_phone", 5)], [("email", 6)]]
    assert [r.text for r in pii.redact(more).orderBy("doc_id").collect()][5] == "mail: [email]" and pii.redact(more).columns == more.columns
    assert pii.find_pii(more.limit(0)).count() == 0


# ---- decontamination


def _brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, of = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for at in range(len(w) - m + 1):
                if w[at : at + m] == p[i : i + m]:
                    hit |= set(range(at, at + m))
                    of.add(str(item))
    return len(w), len(hit), sorted(of)


@pytest.mark.parametrize("block", [16_000_000, 60])
def test_decontamination(spark, block):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice(["the", "of", "A", "é", "x1", "y"], n))
    items = [(i, word(int(rng.integers(9, 25)))) for i in range(12)] + [(20, "y y"), (21, None), (22, "..."), (5, "the of the")]
    texts = ODD + [word(60) + " " + items[k % 12][1] + "! " + word(8) for k in range(20)]
    found = decontam.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    got = {r.doc_id: (r.n_words, sum(h.end - h.start for h in r.hits), r["items"]) for r in found.collect()}
    assert got == {i: _brute_hits(t, items) for i, t in enumerate(texts)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs(spark, texts), none).count() == len(texts)


# ---- archives


def test_warc(spark):
    big = "<html>" + "é" * 200
    rows = [(5, "u", big), (3, "u v", big), (9, None, big), (3, "u", big), (1, "a", "short"), (2, "a", "short"), (4, "n", None), (6, "l", LONG), (7, "\r\nX: y", "z" * 100), (None, "q", big)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = 3 if html == big and page != 3 else None
        want.append((page or 0, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if first else "response", first))
    assert got == sorted(want, key=str)
    some = warc.read_records(index.filter("page_id = 6")).collect()
    assert [bytes(r.payload).decode() for r in some] == [LONG]
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    assert warc.ranges([(0, 10), (10, 5), (200, 5), (204, 9)], gap=50, most=100) == [[0, 1], [2, 3]]


# ---- exact copies


@pytest.mark.parametrize("hot", [1_000, 2])
def test_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(dedup, "HOT_ROWS", hot)
    index = dedup.DigestIndex(spark, shared_path(spark, "index"), 4)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    table = docs(spark, ODD)
    got = {r.doc_id: r for r in index.deduplicate(table).collect()}
    for i, t in enumerate(ODD):
        same = [j for j, u in enumerate(ODD) if low(u) == low(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(low(t).encode()).hexdigest())
    again = dedup.DigestIndex(spark, index.path, 4)
    second = {r.doc_id: r.kept for r in again.deduplicate(spark.createDataFrame([(100, "SAME text here now"), (101, "new")], "doc_id long, text string")).collect()}
    assert second == {100: False, 101: True} and again.read().count() == len({low(t) for t in ODD}) + 1
    assert dedup.exact_dedup(table).columns == table.columns and dedup.exact_dedup(table.limit(0)).count() == 0


# ---- near copies


def _brute_fp(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 80)) for _ in range(6)]
    texts = ODD + [b if k == 0 else b.replace("w1", f"v{k}", 1) for b in base for k in range(4)]
    got = {r.doc_id: r for r in simhash.near_duplicate_classes(docs(spark, texts)).collect()}
    fps = [_brute_fp(t) for t in texts]
    assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == fps
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[i] = min(root[i], root[j])
    assert [got[i].component_id for i in range(len(texts))] == root
    kept = simhash.near_dedup(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and simhash.near_dedup(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [50_000, 4, 1])
def test_trie_join_loses_no_link(spark, bucket):
    rng = np.random.default_rng(1)
    fps = {0, 2**64 - 1}
    for b in rng.integers(0, 2**62, 60):
        for _ in range(5):
            x = int(b)
            for k in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    v = np.array(sorted(fps), np.uint64)
    table = spark.createDataFrame([(int(x), i) for i, x in enumerate(v.view(np.int64))], "fp long, node long")
    got = [tuple(sorted((r.a, r.b))) for r in simhash.near_pairs(table, 3, bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= 3) if i < j}
    trees = [tuple(r) for r in simhash.near_pairs(table, 3, bucket, forest=True).collect()]
    roots = []
    for links in (got, trees):
        root = np.arange(len(v))
        simhash.unite(root, *np.array(links).T)
        roots.append(simhash._roots(root, np.arange(len(v))).tolist())
    assert roots[0] == roots[1]


def test_trees_of_links():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 30), (50, 400), (2_000, 1_500)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        root, least = np.arange(n), np.arange(n)
        for at in range(0, m, 100):
            simhash.unite(root, i[at : at + 100], j[at : at + 100])
        for _ in range(n):
            before = least.copy()
            for a, b in zip(i, j, strict=True):
                least[a] = least[b] = min(least[a], least[b])
            if (before == least).all():
                break
        assert (simhash._roots(root, np.arange(n)) == least).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 200: 150, 201: 150}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- learnt operators


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    texts, marks = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = list(rng.choice([f"w{k}" for k in range(300)], 40)) + (list(rng.choice(["vilest", "rotten", "hateful"], 3)) if bad else [])
        rng.shuffle(words)
        texts.append(" ".join(words))
        marks.append(int(bad))
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, texts + ODD), labels).collect()}
    assert len(got) == len(texts) + len(ODD) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in range(600) if got[i].held_out]
    assert np.mean([got[i].predicted == marks[i] for i in held]) > 0.95
    assert [(got[i].predicted, 0 <= got[i].score <= 1) for i in range(600, 600 + len(ODD))] == [(0, True)] * len(ODD)
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r.doc_id: r.score for r in toxicity.toxicity(docs(spark, texts), changed).collect()}
    same = {r.doc_id: r.score for r in toxicity.toxicity(docs(spark, texts), labels).collect()}
    assert other == same  # held-out labels have no part in it
    assert all(r.score < 1e-9 for r in toxicity.toxicity(docs(spark, ODD), labels.limit(0)).collect())


def test_quality(spark):
    good = ["The quick brown fox jumps over a lazy dog number %d and more words follow here." % i for i in range(150)]
    bad = ["a | b | c | d | %d | e | f | g | h" % i for i in range(50)]
    texts = good + bad
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs(spark, texts + ODD), labels).collect()}
    assert len(got) == 200 + len(ODD) and np.mean([got[i].keep == (i < 150) for i in range(200)]) > 0.98
    r = got[0]
    assert min(0, 1) <= r.host_rate <= 1 and 0 <= r.path_rate <= 1
    kept = quality.keep_good(docs(spark, texts), labels)
    assert kept.columns == docs(spark, texts).columns and quality.quality(docs(spark, ODD), labels.limit(0)).count() == len(ODD)
    assert quality.quality(docs(spark, ODD).limit(0), labels).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(i, f"Plain words in a sentence of sort {i} that says little more than that.", "en", "big") for i in range(300)] + [(1000, "x | y | z", "en", "tiny")]
    rows += [(300 + i, "a | b | %d | c | d" % i, "en", "junk") for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], int(r[3] == "big"), 0) for r in rows], "doc_id long, quality int, toxic int")
    rate = {r.host: r.host_rate for r in quality.quality(table, labels).collect()}
    assert rate["junk"] < rate["tiny"] < rate["big"]  # one bad page doesn't make a bad site


def test_mixing(spark):
    texts = [f"word {i} " * (1 + i % 7) for i in range(400)] + ["a | b"] * 40 + ODD
    how = mixing.Mix(source={"s0": 0.5, "s1": 0.25}, lang=1.0, topic=1.0, budget=1.0)
    got = mixing.mix(docs(spark, texts), how).collect()
    assert len(got) == len(texts)
    total = sum(r.n_tokens for r in got)
    share = lambda s: sum(r.n_tokens * r.weight for r in got if r.source == s) / total
    assert abs(share("s0") - 0.5) < 1e-6 and abs(share("s1") - 0.25) < 1e-6
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in got)
    assert abs(sum(r.rate * r.n_tokens for r in got) / total - 1) < 1e-6
    short = [r for r in got if r.n_tokens < 100]
    assert abs(sum(r.copies for r in short) / sum(r.rate for r in short) - 1) < 0.15
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(spark, texts).repartition(5), how).collect()), key=str)
    assert mixing.mix(docs(spark, ODD).limit(0)).count() == 0
    goals = [np.array([0.3, 0.7]), np.array([0.6, 0.4])]
    w = mixing.rake(np.array([10.0, 20, 30, 40]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], goals)
    assert np.allclose([w[0] + w[1], w[0] + w[2]], [0.3, 0.6]) and abs(w[0] * w[3] / (w[1] * w[2]) - 10 * 40 / (20 * 30)) < 1e-6  # odds ratios stay


def test_licenses(spark):
    def brute(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        have = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        out = set()
        for name, t in licenses.TEMPLATES:
            p = licenses._words(t)
            want = {tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))}
            if len(have & want) >= 0.8 * len(want):
                out.add(name)
        return ",".join(sorted(out))

    full = {n: t for n, t in licenses.TEMPLATES}
    noise = " ".join(f"n{i}" for i in range(300))
    texts = ODD + [t for _, t in licenses.TEMPLATES] + [f"{noise} {t} {noise}" for _, t in licenses.TEMPLATES] + [" ".join(t.split()[: len(t.split()) // 2]) for _, t in licenses.TEMPLATES]
    texts += [full["BSD"].upper().replace(" ", "\n"), full["GPL-3.0"].replace("General", "Special"), "license " * 500, noise + full["ISC"].replace("purpose", "use")]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert licenses.scan_licenses(docs(spark, ODD).limit(0)).count() == 0


# ---- queries


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in frame.values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in os.listdir(SF):
            con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
        assert _rows(got) == _rows(con.sql(queries.oracle_sql()[name]).df())
