"""Each operator against brute force, on small rows with nulls, ties, repeats and clashing names."""

import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import components, decontaminate, embedding_dedup, language_id, minhash_dedup, mixing, suffix_dedup, token_counts, toxicity, url_filter, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source=lambda i: "s", lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t or "")) for i, t in enumerate(texts)], DOC)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# ---------------------------------------------------------------- components


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(200, 230)] + [(70, 71), (71, 70), (5, 5)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    pairs += [(9000, x) for x in range(2000, 2300)] + [(x, 1900) for x in range(2000, 2300, 7)]  # a hub above its neighbours, and one below
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 embeddings


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 16))
    rows = []
    for i in range(120):
        v = base[i % 20] + rng.standard_normal(16) * (0.05 if i % 3 else 0.3)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [None] + [1.0] * 15, 0), (205, [math.nan] * 16, 0), (206, rows[0][1], None), (207, [math.inf] * 16, 1), (208, [], 1), (209, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash")).withColumn("component_id", F.lit(1))
    good = {i: (np.array(v), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0}
    link = {i: {j for j in good if j != i and good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] / np.linalg.norm(good[i][0]) / np.linalg.norm(good[j][0]) >= 0.98} for i in good}
    for r in embedding_dedup.near_duplicates(df).collect():
        seen, todo = {r.vec_id}, [r.vec_id]
        while todo:
            new = link.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (r.n_links, r.component_id, r.kept) == (len(link.get(r.vec_id, ())), min(seen), min(seen) == r.vec_id)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 2 tokens


def greedy(word, pieces):
    n, i = 0, 0
    while i < len(word):
        i += max(k for k in range(1, len(word) - i + 1) if k == 1 or word[i : i + k] in pieces)
        n += 1
    return n


def test_token_counts(spark):
    rng = random.Random(2)
    pieces = {bytes(rng.choice(b" abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)}
    texts = ["".join(rng.choice("abc \n\u00a0é") for _ in range(rng.randrange(0, 80))) for _ in range(60)] + [None, "", "   ", "a" * 5000]
    df = docs_of(spark, texts).withColumn("n_tokens", F.lit("clash")).withColumn("_key", F.lit(0))
    for r in token_counts.token_counts(df, sorted(pieces)).collect():
        words = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w, pieces) for w in words))


def test_token_counts_of_long_pieces_and_empty_tables(spark):
    pieces = [b"a" * 290, b"b" * 300]
    texts = ["a" * 290 + "b", "b" * 299, "b" * 300, "a" * 1000]
    df = docs_of(spark, texts + texts)
    got = sorted(token_counts.token_counts(df, pieces).collect())
    assert [r.n_tokens for r in got] == [greedy(b" " + t.encode(), set(pieces)) for t in texts + texts]
    assert token_counts.token_counts(df.limit(0), pieces).count() == 0


# ---------------------------------------------------------------- 3 WARC


def test_archives_inside_payloads(spark, tmp_path):
    """Members that stand uncompressed inside a payload are no records, however the file is split; appends add up."""
    warc.register(spark)
    inner = b"".join(warc.gzip_member(warc.encode_record(dict(record_id=f"inner{i}", target_uri="u", payload=bytes(range(256)) * 8)), 0) for i in range(4))
    rows = [(f"r{i}", "response", inner if i % 2 else b"plain" * 400) for i in range(8)]
    df = spark.createDataFrame(rows, "record_id string, record_type string, payload binary").coalesce(2)
    where = str(tmp_path / "w")
    schema = {x.split()[0]: x.split()[1] for x in warc.SCHEMA.split(", ")}
    full = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()])
    for part in ("record_id < 'r4'", "record_id >= 'r4'"):
        full.filter(part).write.format("warc").mode("append").option("path", where).option("level", "0").option("mark_bytes", "1").save()
    read = spark.read.format("warc").option("path", where).option("split_bytes", "1").load()
    assert read.rdd.getNumPartitions() == 8
    assert sorted((r.record_id, bytes(r.payload)) for r in read.collect()) == [(i, p) for i, _, p in rows]


def test_warc_empty_table_and_long_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "é" * 2_000_000), (2, "u", "é" * 2_000_000)], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in warc.round_trip(pages, str(tmp_path / "long")).collect())
    sha = hashlib.sha1(("é" * 2_000_000).encode()).hexdigest()
    assert got == [(1, 4_000_000, sha, "revisit", 2), (2, 4_000_000, sha, "response", None)]
    assert warc.round_trip(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1200
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (5, None, big), (3, "http://b/é \r\n", "small"), (4, "http://b", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "ü" * 600), (8, "u", "ü" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    got = sorted(warc.round_trip(pages, str(tmp_path / "w")).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    want = []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        top = max((j for j, _, x in rows if x == h and j is not None), default=None)
        again = len(raw) >= 1000 and i != top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    assert [tuple(r) for r in got] == want


def test_warc_filters_and_foreign_files(spark, tmp_path):
    warc.register(spark)
    rows = [dict(record_id=f"urn:page:{i}", record_type=("response", "metadata")[i % 2], target_uri=f"http://h{i % 3}/", payload=bytes([65 + i]) * 50) for i in range(12)]
    records = [warc.encode_record(r) for r in rows]
    d = tmp_path / "w"
    d.mkdir()
    (d / "a.warc").write_bytes(b"".join(records[:4]))
    (d / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[4:8])))
    (d / "c.warc.gz").write_bytes(b"".join(map(warc.gzip_member, records[8:])))
    read = lambda **o: spark.read.format("warc").options(path=str(d), **o).load()
    assert {(r.record_id, bytes(r.payload)) for r in read().collect()} == {(r["record_id"], r["payload"]) for r in rows}
    some = read(split_bytes="64", payload="false").filter("record_type = 'metadata' and target_uri like 'http://h1%'")
    assert {r.record_id for r in some.collect()} == {r["record_id"] for i, r in enumerate(rows) if i % 2 and i % 3 == 1}
    assert all(r.payload is None and r.payload_length == 50 for r in some.collect())


# ---------------------------------------------------------------- 4 URLs


def test_url_filter(spark):
    rules = url_filter.parse_rules(["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"])
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "http://notorg/es/", "http://x.com/fr/", "http://x.com/de", "http://x.com/de/1?u=http://y.org/", "no scheme", None, "", "x://h", "http://org/", "http://org", "http://a.com?x/fr/", "s://a://b/c#d"] + [f"http://w{i}.net/{'es' if i % 2 else 'en'}/{i}" for i in range(40)] + [f"http://w{i}.example.org/{('es', 'en')[i % 2]}/{i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("_rule", F.lit(1))

    def parse(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        i = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        path = rest[i:]
        j = next((k for k, c in enumerate(path) if c in "?#"), len(path))
        return "".join(c.lower() if c.isascii() else c for c in rest[:i]), path[:j]

    for r in url_filter.judge(pages, rules).collect():
        host, path = parse(urls[r.page_id])
        fit = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.text), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best.text)
        assert r.verdict == best.verdict if best else r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_trees_take_the_best_splits(spark):
    """A tree's splits and leaves against sums over the rows for every feature and cut."""
    rng = random.Random(11)
    names, cuts = ["f_a", "f_b", "f_c"], {"f_a": [1, 4, 6], "f_b": [2], "f_c": [0, 3]}
    rows = [(*(rng.randrange(len(cuts[c]) + 1) for c in names), rng.uniform(-1, 1), rng.uniform(0.05, 0.25)) for _ in range(200)]
    graded = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names) + ", _g double, _h double")
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("bin")) for c in names]))
    f, cut, below, above = url_filter._grow(graded, stacked, cuts, 0.5, 1.0)

    def best(part):
        def value(x):
            return sum(r[3] for r in x) ** 2 / (sum(r[4] for r in x) + 1)

        def split(k, i):
            return [r for r in part if r[k] <= i], [r for r in part if r[k] > i]

        gain, k, i = max((value(split(k, i)[0]) + value(split(k, i)[1]) - value(part), k, i) for k, c in enumerate(names) for i in range(len(cuts[c])))
        return names[k], cuts[names[k]][i], [0.5 * sum(r[3] for r in x) / (sum(r[4] for r in x) + 1) for x in split(k, i)], split(k, i)

    name, at, _, halves = best(rows)
    assert (f, cut) == (name, at)
    for got, half in zip((below, above), halves, strict=True):
        name, at, leaves, _ = best(half)
        assert got[:2] == [name, at] and got[2:] == pytest.approx(leaves)


def test_url_trees_hold_out_and_odd_rows(spark):
    """Trees tell blocked from allowed hosts that they were not fitted on; repeated and long URLs; many suffixes."""
    rules = url_filter.parse_rules(["allow good.org/", "block bad.net/"])
    rng = random.Random(4)
    ruled = [(f"http://h{i}.good.org/a/b" if i % 2 else f"https://x{rng.randrange(10**9)}.h{i}.bad.net/?a=1&b={rng.randrange(10**9)}") for i in range(600)]
    other = ["http://h1.other.com/a/b", f"https://x{rng.randrange(10**9)}.h3.other.com/?a=1&b={rng.randrange(10**9)}"]
    rows = list(enumerate(ruled)) + [(10_000 + i, u) for i, u in enumerate(other * 2)] + [(None, other[0]), (7, "http://l.com/" + "a" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("k", F.lit("clash")).withColumn("rate", F.lit(1))
    got = url_filter.judge(pages, rules, sample_rows=300).collect()
    assert len(got) == len(rows)
    verdict = {r.page_id: r.verdict for r in got}
    assert [verdict[10_000 + i] for i in range(4)] == ["allow", "block"] * 2 and verdict[None] == "allow"
    wrong = sum((r.score >= 0.5) != (r.verdict == "block") for r in got if r.rule)
    assert wrong <= 6


# ---------------------------------------------------------------- 5 suffixes


def brute_cut(rows, t):
    first, out = {}, {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        for k in range(len(b) - t + 1):
            first.setdefault(b[k : k + t], i)
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - t + 1):
            if first[b[k : k + t]] < i:
                gone[k : k + t] = b"\1" * t
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark):
    rng = random.Random(3)
    shared = [prose(rng, 20) for _ in range(6)]
    texts = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(0, 25))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a : a + rng.randrange(30, 90)], prose(rng, 3)]
        texts.append(rng.choice(["", "é"]).join(parts))
    texts += [None, "", texts[0], texts[3], "z" * 300, "z" * 120, shared[0], shared[0][:50], shared[0][:49]]
    df = docs_of(spark, texts).withColumn("_id", F.lit("clash")).withColumn("_batch", F.lit(1))
    want = brute_cut(list(enumerate(texts)), 50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_report(df, batch_bytes=900).collect()}
    assert got == want
    cut = suffix_dedup.remove_repeats(df, batch_bytes=900)
    assert cut.columns == df.columns
    for r in cut.collect():
        assert (r.text is None) == (texts[r.doc_id] is None) and len((r.text or "").encode()) >= want[r.doc_id][0] - want[r.doc_id][1]
        assert "\ufffd" not in (r.text or "")
    assert suffix_dedup.dedup_report(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 6 MinHash


def brute_groups(texts, n, hundredths):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= hundredths * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "threshold"), [(3, 0.85), (5, 0.8)])
def test_minhash(spark, n, threshold, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "TEXT_BLOCK", 8)
    rng = random.Random(n)
    bases = [prose(rng, 120, 2000).split() for _ in range(12)]
    texts = []
    for i in range(130):
        w = list(bases[0 if i % 3 else i % 12])
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [None, "", " \t", "one", "ONE", "two words", texts[0].upper(), texts[0], texts[0] + " "]
    df = docs_of(spark, texts).withColumn("id", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df, n=n, threshold=threshold).collect()}
    assert got == brute_groups(texts, n, round(100 * threshold))
    assert {r.doc_id for r in minhash_dedup.keep_one(df, n=n, threshold=threshold).collect()} == {i for i, v in got.items() if v[2]}


def test_sketch_estimates_similarity_and_fills():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    one, two = minhash_dedup.sketch([np.unique(a), np.unique(b)])
    assert abs((one == two).mean() - 240 / 360) < 0.15
    tiny = minhash_dedup.sketch([np.array([7], np.uint64)])
    assert (tiny != np.iinfo(np.uint64).max).all()


def test_minhash_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "q r s t u"), (2, "q r s t u"), (3, "other words stand here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(minhash_dedup.near_duplicates(df, n=3).collect(), key=str)
    assert len(got) == 5
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(1, 1), (2, 1), (3, 3)}


# ---------------------------------------------------------------- 7 mixing


def test_mixing(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(0, 30)) for _ in range(400)] + [None, ""]
    names = ["b", "a", None, "é", "c"]
    df = docs_of(spark, texts, source=lambda i: names[0 if i % 2 else i % 5]).withColumn("size", F.lit("clash")).withColumn("copies", F.lit(0))
    rows = mixing.mix(df).collect()
    assert rows and sorted(rows) == sorted(mixing.mix(df).collect())
    size = {}
    for r in rows:
        assert r["size"] == len((texts[r.doc_id] or "").split()) and r.taken in (0, r["size"], 2 * r["size"])
        size.setdefault(r.source, [0, r.target, 0, 0])
        size[r.source][0] += r["size"]
        size[r.source][2] += r.taken
        size[r.source][3] = max(size[r.source][3], r["size"])
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(v[0] for v in size.values()), {}, set(order)
    while True:
        level = (left - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * size[s][0]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s][0]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    for s, (_, t, taken, most) in size.items():
        assert t == pytest.approx(target[s]) and abs(taken - t) <= most
    kept = mixing.mixed(df)
    assert kept.count() == sum(r.copies > 0 for r in rows) and mixing.mix(df.limit(0)).count() == 0


def test_mixing_ties(spark):
    """Rows that are equal in id and size: as many are taken as fit, wherever they stand."""
    rows = [(None, "one two three four five", "a")] * 100 + [(7, "one two three", "b")] * 40 + [(i, "x y z", "b") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_rank", F.lit("clash")).withColumn("target", F.lit(1)).repartition(5).sortWithinPartitions("doc_id")
    for out in (mixing.mix(df), mixing.mixed(df)):
        got = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
        assert len(got) == 2
        assert all(abs(r.taken - r.target) <= 5 and r.most <= 2 for r in got)
    assert set(mixing.mixed(df).columns) >= {"_rank", "_own_target", "target"}
    same = spark.createDataFrame([(1, "a b c d", "s")] * 30, "doc_id long, text string, source string")
    (r,) = mixing.mix(same, share=0.5).agg(F.sum("taken").alias("n"), F.max("copies").alias("m")).collect()
    assert (r.n, r.m) == (60, 1)


# ---------------------------------------------------------------- 8 language


def test_language_counts_equal_exact_sets():
    """Corrected filter counts against exact n-gram sets, and the decision against theirs."""
    rng = np.random.default_rng(3)
    members = [rng.integers(0, 2**40, 4000).astype(np.uint64) for _ in range(9)]
    f = language_id.LanguageFilters([f"l{i}" for i in range(9)], members, 18)
    sets = [set(m.tolist()) for m in members]
    for best in range(9):
        gram = np.concatenate([rng.choice(members[best], 300), rng.choice(members[(best + 4) % 9], 100), rng.integers(2**41, 2**42, 200).astype(np.uint64)])
        counts, total = f.counts(gram, np.zeros(len(gram), np.int64), 1)
        exact = np.array([sum(g in s for g in gram.tolist()) for s in sets])
        assert total[0] == 600 and np.abs(counts[0] - exact).max() <= 12 and counts[0].argmax() == exact.argmax() == best


def test_language_nulls_repeats_and_long_texts(spark):
    rows = [(1, "guten tag welt", "de"), (1, "guten tag welt", "de"), (None, "guten tag", None), (2, "guten tag " * 60_000, None), (3, None, "de"), (4, "12 34", "de"), (5, "hello world", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.train(docs.filter("doc_id is not null"))
    got = [(r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in language_id.predict(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "de", True), (1, "de", True), (None, "de", True), (2, "de", True), (3, "und", True), (4, "und", True), (5, "en", True)], key=str)
    assert language_id.identify(docs.limit(0)).count() == 0




def test_language_id(spark):
    rng = random.Random(6)
    parts = {"aa": ["tha", "ing", "wer"], "bb": ["ción", "que", "llo"], "cc": ["schu", "ung", "ber"]}
    lang = ["aa", "bb", "cc"]
    texts = [" ".join("".join(rng.choice(parts[lang[i % 3]]) for _ in range(3)) for _ in range(20)) for i in range(300)]
    df = docs_of(spark, [*texts, None, "123 !", ""], lang=lambda i: lang[i % 3] if i % 10 else None).withColumn("lang_pred", F.lit("clash"))
    rows = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= rows[i].score <= 1 for i in rows)
    assert sum(rows[i].lang_pred == lang[i % 3] for i in range(300)) >= 290
    assert all(rows[i].lang_pred == "und" for i in (300, 301, 302))
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_filters_hold_what_was_put_in():
    members = [np.arange(100, dtype=np.uint64), np.arange(50, 150, dtype=np.uint64)]
    f = language_id.LanguageFilters(["a", "b"], members, 14)
    n, _ = f.counts(np.arange(50, 100, dtype=np.uint64), np.zeros(50, np.int64), 1)
    assert n[0, 0] > 49 and n[0, 1] > 49


# ---------------------------------------------------------------- 9 leaks


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, ". ".join(prose(rng, rng.randrange(6, 20), 3000) for _ in range(2)) + ".") for i in range(60)] + [(60, None), (61, ""), (62, items_text := "Short item here.")]
    texts, want = [], set()
    for i in range(200):
        body = prose(rng, rng.randrange(0, 200), 3000).split()
        if i % 5 == 0:
            k = rng.randrange(60)
            at = rng.randrange(len(body) + 1)
            body[at:at] = [items[k][1].upper() if i % 2 else items[k][1].replace(" ", "\n")]
            want.add((i, k))
        texts.append(" ".join(body))
    texts += [None, "", f"see: {items_text}"]
    want.add((202, 62))
    df = docs_of(spark, texts).withColumn("item_id", F.lit("clash"))
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    for shard in (2 << 20, 2000):  # the index in one part or in several
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, table, shard_bytes=shard).collect()} == want
    left = decontaminate.drop_leaks(df, table)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == set(range(203)) - {d for d, _ in want}
    assert decontaminate.find_leaks(df, table.limit(0)).count() == 0


def test_retrieval_equals_full_scores(monkeypatch):
    monkeypatch.setattr(decontaminate, "RUN", 4)
    rng = random.Random(8)
    for vocabulary, threshold in ((200, 0.5), (60, 0.6), (2000, 0.3)):
        items = [(i, prose(rng, rng.randrange(5, 30), vocabulary)) for i in range(150)]
        index = decontaminate.ItemIndex(items)
        size, mean = len(items), sum(len(t.split()) for _, t in items) / len(items)
        df = {}
        for _, t in items:
            for x in set(t.split()):
                df[x] = df.get(x, 0) + 1
        text_of = dict(items)

        def score(item, window):
            own = text_of[index.ids[item]].split()
            part = {x: math.log(1 + (size - df[x] + 0.5) / (df[x] + 0.5)) * own.count(x) * 2.2 / (own.count(x) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for x in set(own)}
            return sum(v for x, v in part.items() if x in window) / sum(part.values())

        for _ in range(12):
            w = prose(rng, rng.randrange(1, 60), vocabulary).split() + rng.choice(items)[1].split() + prose(rng, 20, vocabulary).split()
            numbers = np.array([index.terms.get(x.encode(), -1) for x in w])
            want = set()
            for b in range(index.blocks):
                for s in index.passages(len(w), b).tolist():
                    window = set(w[s : s + 2 * index.longest[b]])
                    want |= {(s, j) for j in range(8 * b, min(8 * b + 8, size)) if score(j, window) >= threshold}
            assert want and index.retrieve(numbers, threshold) == want
            terms = np.unique(numbers[numbers >= 0])
            assert sorted(index.wand(terms, 0, size, threshold)) == [j for j in range(size) if score(j, set(w)) >= threshold]


def test_decontamination_nulls_repeats_and_long_texts(spark):
    rng = random.Random(12)
    item = "What is asked here by whom and why so. The answer is given in words."
    long = prose(rng, 60_000, 5000) + " " + item + " " + prose(rng, 10)
    docs = spark.createDataFrame([(None, item), (1, item), (1, item), (2, None), (3, ""), (4, long)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == sorted([("None", 7), ("1", 7), ("1", 7), ("4", 7)] * 2)
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0 and decontaminate.drop_leaks(docs.limit(0), items).count() == 0


# ---------------------------------------------------------------- 10 toxicity


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["grumf", "snodalot", "snodaria", "snodex"]
    rows, marks = [], []
    for i in range(400):
        w = prose(rng, rng.randrange(5, 60)).split()
        toxic = i % 7 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append(" ".join(w))
        marks.append((i, int(toxic)))
    df = docs_of(spark, [*rows, None, ""]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.assess(df, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    assert all(got[i].predicted == toxic for i, toxic in marks)
    assert got[400].predicted == got[401].predicted == 0
    assert {r.doc_id for r in toxicity.reject(df, labels).collect()} == {i for i in got if not got[i].predicted}
    assert {r.predicted for r in toxicity.assess(df, labels.limit(0)).collect()} == {0}


def test_grammar_reads_clauses():
    g = toxicity.Grammar(whole={"idiot": 4.0}, stems={"snod": 3.0})
    find = g.finder()
    weigh = lambda t: g.weigh(t, find)
    assert weigh("an idiot") == 4.0 and weigh("idiot you are") == 4.0 + toxicity.TARGETED and weigh("not an idiot") == 4.0 - toxicity.NEGATED
    assert weigh("not in the end an idiot") == 4.0 and weigh("you aren't an idiot") == 4.0 - toxicity.NEGATED + toxicity.TARGETED
    assert weigh("mary said: idiot") == 4.0 - toxicity.REPORTED and weigh("she said: idiot") == 4.0 - toxicity.REPORTED + toxicity.TARGETED
    assert weigh("Snodding about. IDIOT! you") == 7.0 and weigh("idiotic unsnod") == 0.0
    assert weigh("kill") == 0.0 and weigh("I will kill you") == 4.0 + toxicity.TARGETED and weigh(None) == weigh("") == 0.0


def test_composed_machine_equals_all_paths():
    """The best path of the composed machine against every path through the five transducers, one after the other."""

    def outputs(clause):
        paths = {(tuple(s for s, _ in clause), tuple(0.0 for _ in clause), tuple(0 for _ in clause))}
        for t in toxicity.chain():
            after = set()
            for symbols, constants, own in paths:
                todo = [(start, (), (), ()) for start in t.starts]
                for s, c, o in zip(symbols, constants, own, strict=True):
                    todo = [(a.to, (*w, a.writes), (*k, c + a.constant), (*m, o + a.own)) for state, w, k, m in todo for a in t.arcs[state] if a.reads == s]
                after |= {(w, k, m) for state, w, k, m in todo if state in t.finals}
            paths = after
        return max((sum(k) + sum(o * w for o, (_, w) in zip(m, clause, strict=True)) for _, k, m in paths), default=0.0)

    rng = random.Random(10)
    symbols = (*toxicity.WORDS, toxicity.QUOTE)
    for _ in range(400):
        clause = [(s, rng.choice([0.5, 1.5, 4.0]) if s in (toxicity.INSULT, toxicity.THREAT) else 0.0) for s in rng.choices(symbols, k=rng.randrange(6))]
        assert toxicity.best_path(clause) == pytest.approx(outputs(clause))


def test_toxicity_reads_long_texts_in_linear_time_and_repeats(spark):
    import time

    g = toxicity.Grammar(whole={"idiot": 4.0})
    find = g.finder()
    took = []
    for n in (20_000, 200_000):
        text = "an idiot, then a plain row of words " * n
        began = time.perf_counter()
        assert g.weigh(text, find) == 4.0 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int")
    assert len(toxicity.assess(df, labels).collect()) == 4 and toxicity.assess(df.limit(0), labels).count() == 0
