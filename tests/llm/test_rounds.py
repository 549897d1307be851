"""Hot stars, repeated ids, layouts, repeated batches, clashing columns; and the learnt operators against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import chat, decontam, dedup, licenses, mixing, pii, quality, simhash, toxicity, warc
from keyloom.llm.common import discard, free_name, join_uneven, shared_path, written
from keyloom.llm.components import connected_components


def test_stars_and_chains(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(90)] + [(4999, 9000)] + [(9000, 6000 + i) for i in range(400)]
    table = spark.createDataFrame([(*e, 7, 8) for e in edges] + [(None, 3, 0, 0)], "a long, b long, node long, component long")
    got = {r.node: r.component for r in connected_components(table.repartition(3)).collect()}
    assert got == {**{i: 0 for i in range(3000)}, **{5000 + i: 5000 for i in range(91)}, **{n: 4999 for n in (4999, 9000, *range(6000, 6400))}}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_uneven_join(spark, how):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 600, 1).when(F.col("id") < 990, F.col("id") % 40).when(F.col("id") < 995, 777).alias("k"))
    table = rows.filter("k is not null and k < 777").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = sorted(map(tuple, join_uneven(rows, table, "k", 1000, how).collect()), key=str)
    assert got == sorted(map(tuple, rows.join(table.drop("n"), "k", how).select("id", "k", "m").collect()), key=str)
    kept = written(rows, "kept")
    discard(kept, rows)
    assert rows.count() == 1000 and free_name("A", ["a", "a_"]) == "A__"
    with pytest.raises(Exception, match="(?i)exist|found"):
        kept.count()


def test_repeated_ids_are_one_document(spark):
    words = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(1, words("a")), (5, words("a")), (5, words("b")), (2, words("b")), (3, words("c")), (None, words("c")), (None, words("d")), (9, words("e")), (9, words("e"))]
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, fp int, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicate_classes(table).collect()), key=str)
    assert got == sorted([(1, 1), (5, 1), (5, 1), (2, 1), (3, 3), (None, 3), (None, None), (9, 9), (9, 9)], key=str)
    assert sorted((r.doc_id for r in simhash.near_dedup(table).collect()), key=str) == sorted([1, 3, None, None, 9, 9], key=str)


# ---- toxicity


def _texts():
    rng = np.random.default_rng(21)
    texts = []
    for i in range(500):
        words = list(rng.choice([f"w{k}" for k in range(200)], 30)) + (list(rng.choice(["vilest", "rotten", "hateful", "w7"], 3)) if i % 6 == 0 else [])
        texts.append(" ".join(words) if i % 50 else "")
    return texts


def test_scores_do_not_depend_on_layout(spark):
    texts = _texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6])] * 40 + [(6, None), (None, texts[3])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(500)], "doc_id long, toxic int")
    order = lambda df: sorted(map(str, df.collect()))
    one, seven, fifty = (order(toxicity.toxicity(table.repartition(n), labels.repartition(max(1, n // 2)))) for n in (1, 7, 50))
    assert one == seven == fifty and len(one) == len(rows)


def test_risk_against_brute_force():
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist()) for _ in range(40)]
    texts, w = toxicity.ordered(rows), rng.normal(size=7)
    assert texts[2] == 40 and [texts[1][texts[0] == i].tolist() for i in range(40)] == sorted(rows)
    mine = rng.random(40) < 0.5

    def brute(w):
        f = [sum(w[i] for i in r) + w[-1] for r, m in zip(sorted(rows), mine, strict=True) if m]
        toxic = [1 / (1 + math.exp(x)) for x in f]
        return sum(toxic) / len(f), sum(1 - x for x in toxic) / len(f)

    toxic, clean, gradient = toxicity.risk(w, texts, mine)
    assert np.allclose((toxic, clean), brute(w))
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        assert abs(gradient[i] - (brute(w + step)[0] - brute(w - step)[0]) / 2e-6) < 1e-6
    empty = toxicity.ordered([])
    assert toxicity.risk(w, empty)[:2] == (0.0, 0.0)


# ---- quality


def test_quality_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        host, path = f"h{int(rng.integers(0, 8)) if i % 3 else 0}", f"p{int(rng.integers(0, 3))}"
        good = rng.random() < (0.95 if host in ("h0", "h3") else 0.3)
        rows.append((i, "Plain words make up a sentence of some sort here, number %d it is." % i if good else "a | b | %d | c ###" % i, path, host))
    rows += [(900, "x | y | z", "only", "lone"), (901, "x | y | z", "other", "h0"), (902, None, None, None), (3, rows[3][1], *rows[3][2:])]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, s int, n int, p int")
    labels = spark.createDataFrame([(r[0], int("Plain" in (r[1] or "")), 0) for r in rows[:240]], "doc_id long, quality int, toxic int")
    got = quality.quality(table, labels).collect()
    p = [1 / (1 + math.exp(-r.evidence)) for r in got]
    assert len(got) == len(rows)

    def weight(groups):
        groups = [(s, n, a) for s, n, a in groups if n >= 2]
        n, full = sum(g[1] for g in groups), sum(g[1] * g[2] * (1 - g[2]) for g in groups)
        spread, chance = sum(g[1] * (g[0] / g[1] - g[2]) ** 2 for g in groups), sum(g[2] * (1 - g[2]) for g in groups)
        between = max(0.0, (spread - chance) / n) / (full / n)
        return min(1.0, between / (1 - between))

    host, path = {}, {}
    for r, x in zip(got, p, strict=True):
        for at, key in ((host, r.host), (path, (r.host, r.path))):
            s, n = at.get(key, (0.0, 0))
            at[key] = (s + x, n + 1)
    mean = sum(p) / len(p)
    wide = weight([(*v, mean) for v in host.values()])
    deep = weight([(*v, (wide * host[k[0]][0] + mean) / (wide * host[k[0]][1] + 1)) for k, v in path.items()])
    logit = lambda x: math.log(min(max(x, 1e-4), 1 - 1e-4) / (1 - min(max(x, 1e-4), 1 - 1e-4)))
    for r, x in zip(got, p, strict=True):
        others = (sum(p) - x) / (len(p) - 1)
        host_rate = (wide * (host[r.host][0] - x) + others) / (wide * (host[r.host][1] - 1) + 1)
        s, n = path[r.host, r.path]
        path_rate = (deep * (s - x) + host_rate) / (deep * (n - 1) + 1)
        score = 1 / (1 + math.exp(-(r.evidence + logit(path_rate) - logit(others))))
        assert np.allclose((r.host_rate, r.path_rate, r.score), (host_rate, path_rate, score)) and r.keep == (r.score >= 0.5)
    lone = next(r for r in got if r.doc_id == 900)
    assert abs(lone.host_rate - (sum(p) - 1 / (1 + math.exp(-lone.evidence))) / (len(p) - 1)) < 1e-9  # nothing of its own
    one = quality.quality(table.limit(1), labels).first()
    assert one.host_rate == one.path_rate == 0.5


# ---- mixing


def test_mixing_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))) + (" | x" if i % 4 == 0 else ""), f"l{int(rng.integers(0, 3))}", f"s{int(rng.integers(0, 5))}") for i in range(300)]
    table = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, lang string, source string, weight double, mix_rate int")
    how = mixing.Mix(source=0.5, lang={"l0": 0.6}, topic=1.0, budget=0.7)
    got = {r.doc_id: r for r in mixing.mix(table, how).collect()}
    tokens = {r[0]: len(r[1].split()) for r in rows}
    keys = {r[0]: (r[3], r[2], "table" if "|" in r[1] else "prose") for r in rows}
    total = sum(tokens.values())
    goals = []
    for d, shares in enumerate((0.5, {"l0": 0.6}, 1.0)):
        have = {}
        for i, k in keys.items():
            have[k[d]] = have.get(k[d], 0) + tokens[i]
        if isinstance(shares, dict):
            rest = sum(v for k, v in have.items() if k not in shares)
            goal = {k: shares[k] if k in shares else (1 - sum(shares.values())) * v / rest for k, v in have.items()}
        else:
            goal = {k: v**shares for k, v in have.items()}
        goals.append({k: v / sum(goal.values()) for k, v in goal.items()})
    cells = {}
    for i, k in keys.items():
        cells[k] = cells.get(k, 0) + tokens[i] / total
    start = dict(cells)
    for _ in range(300):
        for d in range(3):
            have = {}
            for k, v in cells.items():
                have[k[d]] = have.get(k[d], 0) + v
            cells = {k: v * goals[d][k[d]] / have[k[d]] if have[k[d]] else 0.0 for k, v in cells.items()}
    for i, r in got.items():
        want = cells[keys[i]] / start[keys[i]] if start[keys[i]] else 1.0
        assert abs(r.weight - want) < 1e-6 and abs(r.rate - 0.7 * want) < 1e-6 and r.n_tokens == tokens[i] and r.copies - math.floor(r.rate) in (0, 1) and r.mix_error < 1e-8
    kept = mixing.mixed(table, how)
    assert kept.columns == [*table.columns, "mix_weight", "mix_rate_", "mix_copies"]
    assert {(r.doc_id, r.mix_rate, r.mix_copies) for r in kept.collect()} == {(i, 2, r.copies) for i, r in got.items() if r.copies}
    # cells that no weights fit: the error that is left is told
    apart = spark.createDataFrame([(1, "a", "x", "s"), (2, "a", "y", "t")], "doc_id long, text string, lang string, source string")
    assert mixing.mix(apart, mixing.Mix(source={"s": 0.9, "t": 0.1}, lang={"x": 0.1, "y": 0.9}, topic=1.0)).first().mix_error > 0.3
    assert {r.topic for r in mixing.mix(apart, topic=F.col("lang")).collect()} == {"x", "y"}


# ---- the others


def test_repeated_batch(spark):
    index = dedup.DigestIndex(spark, shared_path(spark, "again"), 4)
    table = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (None, "b"), (4, None)], "doc_id long, text string")
    first = sorted(map(str, index.deduplicate(table, batch="monday").collect()))
    assert sorted(map(str, index.deduplicate(table, batch="monday").collect())) == first and index.read().count() == 3
    assert index.deduplicate(table.filter("doc_id is not null"), batch="tuesday").filter("kept").count() == 0
    assert sorted((r.doc_id for r in dedup.exact_dedup(table, index, "monday").collect()), key=str) == sorted([2, 3, 4, None], key=str)


def test_licences_in_any_script(spark):
    own = (("Свободная", "Это произведение можно свободно распространять на условиях этой лицензии."), ("短い", "这个 程序 可以 自由 使用 版权 所有"))
    noise = " ".join(f"слово{i}" for i in range(50))
    table = spark.createDataFrame([(1, f"{noise} {own[0][1].upper()} {noise}", "x"), (2, own[1][1], "y"), (3, noise, "z")], "doc_id long, text string, name string")
    assert {r.doc_id: r.licenses for r in licenses.scan_licenses(table, own).collect()} == {1: "Свободная", 2: "短い", 3: ""}
    assert sorted((r.doc_id, r.name) for r in licenses.license_matches(table, own).collect()) == [(1, "Свободная"), (2, "短い")]


def test_redaction(spark):
    rows = [(1, "mail a@b.c or +1 234 567 8901", [5]), (2, None, None), (3, "", []), (4, "IBAN ES91 2100 0418 4502 0005 1332 BIC", [1]), (4, "é a@b.c", [1])]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans array<int>")
    out = pii.redact(table)
    assert out.columns == table.columns and out.schema["spans"] == table.schema["spans"]
    assert [r.text for r in out.collect()] == ["mail [email] or [phone]", None, "", "IBAN [iban] BIC", "é [email]"]
    assert pii.redact(table.limit(0)).count() == 0
    found = spark.createDataFrame([(1, "konto BE68 5390 0754 7034 ON"), (2, "konto BE68 5390 0754 7035 ON"), (3, "NO9386011117947.")], "doc_id long, text string")
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(found).collect()] == [[("iban", 6, 25)], [], [("iban", 0, 15)]]


def test_many_shared_payloads(spark, monkeypatch):
    big = "<p>" + "x" * 200
    rows = [(i, "u", big if i % 2 else f"{big}{i // 4}", "d", "f") for i in range(500)] + [(None, "u", big, "d", "f"), (600, "u", None, "d", "f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, file string")
    read = lambda: sorted(map(str, warc.read_records(warc.write_archives(pages)).collect()))
    want = read()
    monkeypatch.setattr(warc, "small_enough", lambda df: False)
    assert read() == want and len(want) == len(rows)
    raw = warc.record(1, "u", b"payload", "0" * 64, None)
    with pytest.raises(ValueError, match="broken"):
        warc.parse(raw)
    with pytest.raises(ValueError, match="broken"):
        warc.parse(warc.record(1, "u", b"", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", None).replace(b"X-Payload-Length: 0", b"X-Payload-Length: 1"))


def test_blocks_of_a_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontam, "HELD_BYTES", 300)
    texts = [" ".join(f"w{(i * 7 + k) % 50}" for k in range(20)) for i in range(40)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate([*texts, None])], "doc_id long, text string, item string, hits int")
    items = spark.createDataFrame([(i, texts[i], "y") for i in range(0, 12, 3)] + [(None, "w1 w2", "z")], "item_id long, text string, item string")
    whole, parts = (sorted(map(str, decontam.contamination(table.coalesce(2), items, block_bytes=b).collect())) for b in (16_000_000, 30))
    assert whole == parts and len(whole) == 41


def test_turns_are_what_the_parser_reads(spark):
    rows = [(1, 0, "user", "a </s> b"), (1, 1, "assistant", None), (2, 0, "tool", "[INST] x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(table).withColumn("again", chat.parse(F.col("formatted"))).collect()}
    assert all(r.turns == r.again for r in got.values()) and [t.text for t in got[1].turns] == ["a </s> b", ""]
