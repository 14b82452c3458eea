import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.llm import language, licenses, queries, toxicity
from lineweave.llm import quality as quality_module
from lineweave.llm.common import Bytes, read_table
from lineweave.llm.language import fit_languages, predict_languages
from lineweave.llm.quality import quality
from lineweave.llm.toxicity import fit, score
from tests.conftest import SF
from tests.llm.conftest import edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    w = WORD.findall(text or "")
    seen = defaultdict(list)
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    repeated = {j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, r = len(w), len(repeated)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")) if w else 0, len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_quality_rules(spark, edge, empty):
    labels = read_table(spark, SF, "labels")
    for docs in (edge, read_table(spark, SF, "documents")):
        got = sorted(repr(tuple(r)[:7]) for r in quality(docs, labels).collect())
        assert got == sorted(repr((r["doc_id"], *rules(r["text"]))) for r in docs.select("doc_id", "text").collect())
    assert quality(empty, labels).count() == 0
    assert quality(edge, labels.limit(0)).where("NOT base_failed").select("kept").distinct().collect() == [(True,)]
    carried = quality(edge, labels, carry=["doc_id", "key", "text"])
    assert carried.columns[:3] == ["doc_id", "key", "text"] and carried.count() == edge.count()


def test_ratio_against_naive_counts(spark):
    """Mean log ratios over all trusted documents and all documents; broadcast ids or joined ones."""
    rows = [(i, prose(i % 7, 30 + i)) for i in range(60)] + [(None, prose(3, 40)), (60, ""), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] * 2 + [(None, 1)], "doc_id long, quality int")

    def grams(text):
        data = (text or "").encode()
        from lineweave.llm.quality import Chunk, buckets

        words = data.split()
        assert len(buckets(Chunk([data]))[0]) == len(words) + max(0, len(words) - 1) + max(0, len(data) - 3)
        return buckets(Chunk([data]))[0].tolist()

    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d is not None and d < 60 and d % 3 == 0:
            target.update(grams(t))
    size = quality_module.BUCKETS
    n, m = sum(raw.values()) + size, sum(target.values()) + size
    mean = lambda t: sum(math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in grams(t)) / max(1, len(grams(t)))
    want = sorted((repr(d), mean(t)) for d, t in rows)
    for most in (10**6, 5):
        quality_module.BROADCAST_IDS, old = most, quality_module.BROADCAST_IDS
        try:
            got = sorted((repr(r["doc_id"]), r["ratio"]) for r in quality(docs, labels).collect())
        finally:
            quality_module.BROADCAST_IDS = old
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)
    with pytest.raises(ValueError):
        quality(docs.withColumn("kept", F.lit(1)), labels, carry=["doc_id", "kept"])


def test_quality_keeps_clean_text(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    labels = read_table(spark, sf, "labels")
    found = quality(read_table(spark, sf, "documents"), labels).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").avg("ratio").collect()
    mean = {r["quality"]: r[1] for r in found}
    assert mean[1] > -0.05 > mean[0]
    kept = quality(read_table(spark, sf, "documents"), labels).join(labels.where("quality = 1"), "doc_id").where("NOT base_failed")
    assert kept.where("kept").count() >= 0.99 * kept.count()


def test_language(spark, edge, empty):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = read_table(spark, sf, "documents")
    found = queries.op5_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) > 0.97 * len(found)
    model = fit_languages(docs)
    got = predict_languages(edge, model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 11)} == {"und"}
    assert predict_languages(empty, model).count() == 0
    nothing = fit_languages(empty)
    assert {r["lang_pred"] for r in predict_languages(edge, nothing).collect()} == {"und"}


def naive_language(train, texts):
    """Words first, then ever shorter n-grams, from the definitions."""
    langs = sorted({lang for _, lang in train})
    counts = [defaultdict(lambda: [0] * len(langs)) for _ in range(6)]
    grams = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    for text, lang in train:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            if len(w) <= 64:
                counts[0][w][langs.index(lang)] += 1
            for n in range(1, 6):
                for g in grams(w, n):
                    counts[n][g][langs.index(lang)] += 1
    total = [[sum(c[k] for c in t.values()) + 0.5 * max(1, len(t)) for k in range(len(langs))] for t in counts]
    logs = lambda kind, key: [math.log((c + 0.5) / t) for c, t in zip(counts[kind][key], total[kind], strict=True)]

    def evidence(w):
        if len(w) <= 64 and w in counts[0]:
            found, weight = [logs(0, w)], 1.0
        else:
            found = next((x for n in range(5, 0, -1) if (x := [logs(n, g) for g in grams(w, n) if g in counts[n]])), [[0.0] * len(langs)])
            weight = 0.4
        mean = [sum(c) / len(found) for c in zip(*found, strict=True)]
        return [weight * (x - sum(mean) / len(mean)) for x in mean]

    out = []
    for text in texts:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            out.append(("und", 0.0))
            continue
        many = [1 if len(w) <= 64 else math.ceil(len(w) / 5) for w in words]
        sums = [sum(c) / math.sqrt(sum(many)) for c in zip(*([x * m for x in evidence(w)] for w, m in zip(words, many, strict=True)), strict=True)]
        best = max(range(len(langs)), key=lambda k: (sums[k], -k))
        out.append((langs[best], 1 / sum(math.exp(min(x - sums[best], 0)) for x in sums)))
    return out


def scripts():
    """Texts of an unsegmented script, of a rare language beside a large one, and of others."""
    rng = random.Random(6)
    run = lambda letters, k: "".join(rng.choices(letters, k=k))
    rows = [(run("あいうえおかきくけこ", 90) + "。" + run("あいうえおかきくけこ", 120), "ja") for _ in range(20)]
    rows += [(" ".join(run("абвгдежз", rng.randint(2, 7)) for _ in range(40)), "ru") for _ in range(20)]
    rows += [(prose(700 + i, 40), "en") for i in range(400)] + [(" ".join(run("qxzwyk", rng.randint(2, 7)) for _ in range(40)), "qq") for _ in range(4)]
    return rows


def test_language_against_naive_scorer(spark):
    train = scripts()
    model = fit_languages(spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "doc_id long, text string, lang string").repartition(3))
    assert model.languages == ["en", "ja", "qq", "ru"]
    texts = [t for t, _ in train[::3]] + [prose(5000, 30), "qxq zwy unseenword", "あいう" * 60, "日本", "12 34", None, "", "aaaa " + "い" * 90]
    got = predict_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model, memo=10).orderBy("doc_id").collect()
    want = naive_language(train, texts)
    assert [r["lang_pred"] for r in got] == [w[0] for w in want]
    assert [r["score"] for r in got] == pytest.approx([w[1] for w in want], abs=1e-5)
    assert want[-3][0] == want[-2][0] == "und" and got[len(train[::3]) + 2]["lang_pred"] == "ja"


def test_rare_languages_keep_their_share_of_the_sample(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(scripts())]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=120)
    assert model.languages == ["en", "ja", "qq", "ru"]
    kept = language.bounded_per_group(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 120, "lang").groupBy("lang").count().collect()
    kept = {r["lang"]: r["count"] for r in kept}
    assert kept["qq"] == 4 and kept["ja"] == 20 and 10 <= kept["en"] <= 40


def test_backoff_order():
    train = [("hello " * 5 + "held held", "a"), ("world " * 5 + "word word", "b")]
    got = naive_language(train, ["hello", "helloing", "日本"])
    assert got[0][0] == "a" and got[1][0] == "a" and got[0][1] > got[1][1] > 0.5 and got[2][1] == 0.5


def test_toxicity_against_naive_classifier(spark):
    """Features, ratios, the optimum of the fit and the scores, from their definitions; the second
    script has no ASCII letter."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [prose(i, 6), "".join(rng.choices("жшщчцъ", k=12))]
        toxic = i % 3 == 0
        if toxic:
            words.insert(1, rng.choice(["бранное", "злослово", "vileword"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))

    def naive_features(text):
        t = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
        grams = {t[i : i + n] for n in toxicity.LENGTHS for i in range(len(t) - n + 1)}
        bucket = lambda g: int(Bytes(np.frombuffer(g.encode("utf-32-le"), "<u4")).hashes(np.array([0]), np.array([len(g)]))[0] >> np.uint64(44))
        return {bucket(g) for g in grams}

    sets = [naive_features(t) for _, t, _ in rows]
    seen = [Counter(b for s, r in zip(sets, rows, strict=True) if r[2] == k for b in s) for k in (0, 1)]
    n0, n1 = (sum(r[2] == k for r in rows) for k in (0, 1))
    ratio = {}
    for b in set(seen[0]) | set(seen[1]):
        c0, c1 = seen[0][b] + 0.5, seen[1][b] + 0.5
        r = math.log(c1 / (n1 + 1)) - math.log(c0 / (n0 + 1))
        if seen[0][b] + seen[1][b] >= toxicity.MIN_DOCS and abs(r) >= toxicity.MIN_Z * math.sqrt(1 / c0 + 1 / c1):
            ratio[b] = r
    assert set(np.flatnonzero(model.effect).tolist()) <= set(ratio) and len(ratio) > 50
    # at the optimum of the penalised likelihood every partial derivative vanishes
    weight = {b: model.effect[b] / r for b, r in ratio.items()}
    p = [1 / (1 + math.exp(-(model.bias + sum(model.effect[b] for b in s if b in ratio)))) for s in sets]
    for b, r in ratio.items():
        slope = sum((q - row[2]) * r for q, row, s in zip(p, rows, sets, strict=True) if b in s) / len(rows) + 1e-5 * weight[b]
        assert abs(slope) < 2e-3
    got = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(p, abs=1e-6)
    assert min(got[r[0]] for r in rows if r[2]) > max(got[r[0]] for r in rows if not r[2])


def test_toxicity(spark, edge, empty):
    sf = SF.replace("sf0.001", "sf0.01")
    got = queries.op1_toxicity(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    pos, neg = ([r["score"] for r in got if r["toxic"] == k] for k in (1, 0))
    assert sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    model = fit(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))
    rows = score(edge, model).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert score(empty, model).count() == 0
    blank = fit(empty, read_table(spark, sf, "labels"))
    assert all(r["score"] == pytest.approx(blank.base, abs=1e-6) for r in score(edge, blank).collect())


def naive_licenses(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for label, p in licenses.PHRASES.items() for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    found = []
    for t in licenses.templates():
        for start in range(-40, len(w)):
            hit = sum(1 for word, at in t.postings if 0 <= start + at < len(w) and w[start + at] == word)
            if hit >= t.need and start + t.key_at >= 0 and w[start + t.key_at : start + t.key_at + len(t.key)] == t.key:
                found.append((t.label, hit / len(t.postings)))
    join = lambda x: ",".join(sorted(set(x)))
    base = [x for _, x in places]
    starts = [i for i, _ in places]
    score_ = max([s for _, s in found], default=0.5 if places else 0.0)
    return len(w), len(places), min(starts, default=None), max(starts, default=None), join(base), join(base + [x for x, _ in found]), score_


LICENSED = [
    "Released under the MIT License. Licensed under the Apache License, Version 2.0!", "MIT license mit LICENSE general public license", "license", "the gnu GENERAL\nPublic\tLicense, version 3",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "licensed under cc by-nc-sa 4.0 and cc by 4.0", "é mit licensé mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "apache license version 2 0", None, "", "K mit K license",
]


def test_licenses_against_brute_force(spark, edge, empty):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LICENSED)], "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    want = [(r["doc_id"], *naive_licenses(r["text"])) for r in docs.collect()]
    got = [tuple(r) for r in licenses.scan(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert licenses.scan(empty).count() == 0
    labels = Counter(x for r in got for x in r[6].split(","))
    assert {"gpl-3.0", "mit-grant", "cc-by-nc-4.0", "apache-2.0"} <= set(labels)


def test_wrapped_notices_pass_the_trigger(spark):
    for phrase in [*licenses.PHRASES.values(), *(t.key for t in licenses.templates())]:
        assert any(re.search(licenses.TRIGGER, word) for word in phrase)
    notice = "This is free and unencumbered software released into the public%sdomain."
    docs = spark.createDataFrame([(i, notice % gap) for i, gap in enumerate([" ", "\n", "\n# ", "  ", "\t", "-"])], "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(docs).collect()))
    assert got == sorted((r["doc_id"], *naive_licenses(r["text"])) for r in docs.collect())
    assert {r[6] for r in got} == {"unlicense"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, want = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    assert df.columns == want.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))


def test_licenses_stay_native(spark, edge):
    assert "Arrow" not in licenses.scan(edge)._jdf.queryExecution().toString() and "Python" not in licenses.scan(edge)._jdf.queryExecution().toString()


def test_notices_with_every_separator(spark):
    """Words may be parted by anything: whole notices and key phrases alone, against the SQL."""
    rows = []
    for label, text, key in licenses.TEMPLATES:
        for sep in (" ", "  ", "\n", "\n# ", "\r\n * ", "-", "\t", ".", " -- ", "\x00", "_"):
            for words in (text, key):
                rows.append((len(rows), f"before{sep}" + sep.join(words.upper().split()) + f"{sep}after", label))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    c = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    c.sql("CREATE TABLE documents AS SELECT * FROM documents")
    found = c.sql(licenses.oracle())
    for r in found.fetchall():
        row = dict(zip(found.columns, r, strict=True))
        assert {k: got[row["doc_id"]][k] for k in found.columns} == row
    assert all(label in got[d]["labels"].split(",") for d, text, label in rows[::2])
