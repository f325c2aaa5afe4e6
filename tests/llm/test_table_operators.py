"""Operators on tables against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from domframe.llm import common, components, exact_dedup, jaccard, line_dedup, mixing, pieces, quality_classifier, quality_rules, simhash, token_count, toxicity, url_filter

WORD = re.compile(r"[^ \t-\r]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, b string, h string, size string"


def rows_of(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}", 0, "x", "x", "x", "x") for i, t in enumerate(texts)]


def long_words(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(2, 8))) for _ in range(n))


BASE = long_words(1)
TEXTS = [None, "", " ", BASE, BASE, BASE + " tail", long_words(2), long_words(3, 3000), "short one", "short  one", long_words(4) + "\n" + long_words(5), long_words(5) + "\n" + long_words(4)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(TEXTS)
    rows += [rows[3], (None, BASE, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (90, "other text of ninety", "de", None, 1, "", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_against_all_pairs(spark, docs, empty):
    import xxhash

    def fp(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    f = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(f[i] ^ f[j]).count("1") <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {}
    for c, (d, _) in zip(comp, rows, strict=True):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    want = sorted((str(d), f"{x:016x}", str(least.get(c))) for (d, _), x, c in zip(rows, f, comp, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_lose_none(spark):
    r = random.Random(7)
    fps = set()
    for _ in range(40):
        a = r.getrandbits(64)
        fps.add(a)
        for _ in range(6):
            b = a
            for bit in r.sample(range(64), r.randrange(1, 7)):
                b ^= 1 << bit
            fps.add(b)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4}
    for wide in (False, True):
        got = [(x.a, x.b) for x in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), wide).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint")
        root = {x.node: x.root for x in simhash.roots_of(nodes, wide).collect()}
        all_ = {x.node: x.root for x in components.components(spark.createDataFrame(sorted(want), "a bigint, b bigint")).collect()}
        assert root == all_


def test_dense_clusters_give_few_pairs(spark):
    base = random.Random(9).getrandbits(63)
    cluster = [base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(1, 63, 2) if i < j]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in cluster})
    nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    leaders, every = simhash.leader_links(nodes), simhash.links(nodes)
    assert every.count() > len(signed) ** 2 / 3 and leaders.count() < 20 * len(signed)
    assert {x.root for x in simhash.roots_of(nodes).collect()} == {min(signed)}


def test_simhash_keys_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "fps")
    spark.range(5000).selectExpr("xxhash64(id) AS fp").write.parquet(path)
    fps = spark.read.schema("fp bigint").parquet(path)
    for found in (simhash.leader_links(fps), simhash.links(fps, True)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def brute_lines(docs, least):
    """docs: (key, text) in order; numbers of the lines that go."""
    lines = [t.split("\n") for _, t in docs]
    where = {}
    for d, ls in enumerate(lines):
        for i, x in enumerate(ls):
            where.setdefault(x, []).append((d, i))
    out = []
    for d, ls in enumerate(lines):
        gone = set()
        for i, x in enumerate(ls):
            best = 0
            for e, j in where[x]:
                if (e, j) >= (d, i):
                    break
                n = 0
                while i + n < len(ls) and j + n < len(lines[e]) and ls[i + n] == lines[e][j + n]:
                    n += 1
                best = max(best, n)
            if best and sum(len(WORD.findall(y)) for y in ls[i : i + best]) >= least:
                gone |= set(range(i, i + best))
        out.append(sorted(gone))
    return out


@pytest.mark.parametrize("part", [29, 250_000])
def test_line_dedup(spark, monkeypatch, part):
    monkeypatch.setattr(line_dedup, "PART", part)
    r = random.Random(part)
    texts = ["\n".join(r.choice(["a b", "c", "d e f", "g", "", f"x{r.randrange(40)}"]) for _ in range(r.randrange(1, 12))) for _ in range(60)]
    texts += [texts[5] + "\n" + texts[6]] * 4 + ["", "", "p q r s t u\np q r s t u"]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {x.doc_id: x for x in line_dedup.line_dedup(df.withColumn("removed", F.lit("clash")), 5).collect()}
    for i, want in enumerate(brute_lines(list(enumerate(texts)), 5)):
        assert list(got[i].removed) == want, i
        assert got[i].text == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in want)


def test_line_dedup_keeps_other_columns(spark):
    run = "\n".join(long_words(40 + i, 9) for i in range(6))
    names = ["text_hash", "row", "gone", "key", "_key", "_d", "doc", "pos", "line", "a.b"]
    rows = [(i, f"own {i}\n{run}", *[f"{c}{i}" for c in names]) for i in range(4)]
    df = spark.createDataFrame([*rows, rows[2]], ["doc_id", "text", *names])
    got = line_dedup.line_dedup(df)
    assert got.columns == ["doc_id", *names, "text", "n_lines", "removed"]
    for r in got.collect():
        i = r.doc_id
        assert list(r)[1 : 1 + len(names)] == [f"{c}{i}" for c in names] and r.n_lines == 7
        assert (r.text, list(r.removed)) == ((rows[i][1], []) if i == 0 else (f"own {i}", [1, 2, 3, 4, 5, 6]))
    assert got.count() == 5


def test_equal_lines_in_great_number(spark):
    """One footer on every text: all but the first copy go, and what partitions hand on stays small."""
    foot = long_words(7, 45)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id").cast("string"), F.lit("\n" + foot)).alias("text"))
    got = line_dedup.line_dedup(docs).where(F.size("removed") > 0)
    assert got.count() == 2999 and got.where("doc_id = 0 or n_lines <> 2 or text <> concat('own ', doc_id)").count() == 0


def test_line_dedup_edges(docs, empty):
    out = line_dedup.line_dedup(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns[:1] == ["doc_id"] and all(r.text is not None for r in rows)
    assert {r.text for r in rows if r.doc_id == 3} == {BASE}
    assert [r.text for r in rows if r.doc_id == 4] == [""] and [r.text for r in rows if r.doc_id == 11] == [""]
    assert line_dedup.line_dedup(empty).count() == 0


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs, path).collect()) == want
    assert token_count.token_counts(empty, path).count() == 0


def test_pieces(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def digest(text):
        ids = sp.encode(text or "", add_eos=True)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    want = sorted((str(r.doc_id), *digest(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encoded(docs, path).collect()) == want
    assert pieces.encoded(empty, path).count() == 0
    assert all(list(r.ids) == sp.encode(r.text or "", add_eos=True) for r in docs.where("doc_id < 9").distinct().join(pieces.encoded_ids(docs, path).dropDuplicates(["doc_id"]), "doc_id").collect())


def water(sizes, weights, share=1.5):
    total, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(2 * sizes[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > 2 * sizes[i]}
        for i in open_:
            out[i] = left * weights[i] / w
        if not over:
            break
        open_ -= over
        for i in over:
            out[i] = 2 * sizes[i]
    return out


def brute_mix(spark, rows):
    """Copies of each doc_id that the mix takes of rows (doc_id, source, words); doc_ids are distinct."""
    h = {r.d: r.h for r in spark.createDataFrame([(d,) for d, _, _ in rows], "d bigint").select("d", F.xxhash64("d", F.lit(mixing.SEED)).alias("h")).collect()}
    of = {r.h: r.x for r in spark.createDataFrame([(x,) for x in h.values()], "h bigint").select("h", F.xxhash64("h").alias("x")).collect()}
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    size = {n: sum(w for _, s, w in rows if s == n) for n in names}
    total = sum(size.values())
    target = dict(zip(names, water([size[n] for n in names], ([5, 2, 1] * len(names))[: len(names)]), strict=True))
    copies, shape = {}, mixing.shape(total)
    for n in names:
        own = [(d, w) for d, s, w in rows if s == n]
        blocks = max(1, -(-shape.blocks * size[n] // max(total, 1)))
        place = {r.b: r.p for r in spark.createDataFrame([(b,) for b in range(blocks)], "b bigint").select("b", F.xxhash64("b", F.lit(mixing.SEED)).alias("p")).collect()}
        held = {}
        for d, w in own:
            held.setdefault(of[h[d]] % blocks, []).append((h[d], d, w))
        whole = int(target[n] // size[n]) if size[n] else 0
        rest = target[n] - whole * size[n]
        for b in sorted(held, key=lambda b: (place[b], b)):
            words = sum(w for _, _, w in held[b])
            upto = 0
            for _, d, w in sorted(held[b]):
                upto += w
                copies[d] = whole + (words <= rest or (rest > 0 and upto - w / 2 <= rest))
            rest -= words
    return copies


def test_mixing_against_brute_force(spark):
    r = random.Random(30)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "é", None]), r.randrange(0, 60)) for i in range(500)] + [(1000, "big", 9000), (1001, "tiny", 1), (1002, "none", 0)]
    df = spark.createDataFrame([(d, s, "w " * w) for d, s, w in rows], "doc_id bigint, source string, text string")
    want = brute_mix(spark, rows)
    assert {x.doc_id: x.taken for x in mixing.mix_sizes(df).collect()} == {d: w * want[d] for d, _, w in rows}
    assert {x.doc_id: len(x.shards) for x in mixing.mix_sizes(df).collect()} == want


def test_mixing(spark, docs, empty):
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(1, 40), "en", r.choice(["a", "a", "a", "b", "c", "d", None]), 0, "", "", "", "") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x for x in mixing.mix_sizes(df).collect()}
    again = {x.doc_id: x for x in mixing.mix_sizes(df.repartition(5)).collect()}
    assert got == again and len(got) == 600
    names = ["a", "b", "c", "d", None]
    size = {n: sum(len(WORD.findall(x[1])) for x in rows if x[3] == n) for n in names}
    target = dict(zip(names, water([size[n] for n in names], [5, 2, 1, 5, 2]), strict=True))
    for n in names:
        own = [got[x[0]] for x in rows if x[3] == n]
        assert own[0].source_size == size[n] and own[0].target == pytest.approx(target[n])
        assert abs(sum(x.taken for x in own) - target[n]) <= 40
    assert all(x.taken <= 2 * x.size and x.taken == x.size * len(x.shards) for x in got.values())
    assert mixing.mix(df).count() == sum(len(x.shards) for x in got.values())
    assert mixing.mix(df).columns == df.columns
    clash = df.select("doc_id", "text", "source", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in ("h", "block", "target", "n_blocks", "whole", "row", "shard", "order", "passes", "sid")])
    assert sorted(mixing.mix(clash).collect()) == sorted(clash.join(mixing.mix_sizes(clash).select("doc_id", F.explode("shards").alias("_x")), "doc_id").select(*clash.columns).collect())
    assert mixing.mix_sizes(docs).count() == docs.count()
    assert mixing.mix_sizes(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_splitting_tree():
    import numpy as np

    quotas = np.array([100, 7, 0, 33])
    leaves = mixing.split(quotas, 6, 1)
    assert sorted(s for s, _, _ in leaves) == list(range(6))
    assert sum(n for _, _, n in leaves).tolist() == quotas.tolist()
    assert max(int(n.sum()) for _, _, n in leaves) - min(int(n.sum()) for _, _, n in leaves) <= 3
    wide = mixing.nodes((0, 6, np.zeros_like(quotas), quotas), 2, 1)
    below = [x for n in wide for x in mixing.nodes(n, 1, 1)]
    assert sorted((lo, f.tolist(), n.tolist()) for lo, _, f, n in below) == sorted((lo, f.tolist(), n.tolist()) for lo, f, n in leaves)
    for s in range(4):
        runs = sorted((int(f[s]), int(n[s])) for _, f, n in leaves if n[s])
        at = 0
        for first, n in runs:
            assert first == at
            at += n
        assert at == quotas[s]


def test_quality_rules(spark, docs, empty):
    got = quality_rules.judged(docs)
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(not r.kept for r in rows if r.base_failed) and all(r.base_failed for r in rows if r.n_words < 50)
    assert quality_rules.judged(empty).count() == 0
    clean = [long_words(100 + i, 200) for i in range(150)]
    junk = ["".join(random.Random(i).choice("§±µ¶øþ0123456789XYZQ") if j % 7 else " " for j in range(1500)) for i in range(3)]
    df = spark.createDataFrame(rows_of(clean + junk), SCHEMA)
    kept = {r.doc_id: r.kept for r in quality_rules.judged(df).collect()}
    assert sum(kept[i] for i in range(150)) >= 148 and not any(kept[150 + i] for i in range(3))
    assert quality_rules.kept(df).columns == df.columns and quality_rules.kept(df).count() == sum(kept.values())


class BruteModel:
    """Interpolated modified Kneser-Ney of order 4 over the characters of words joined by one space."""

    def __init__(self, texts):
        self.levels = {4: {}}
        for t in texts:
            for g in self.grams(t):
                self.levels[4][g] = self.levels[4].get(g, 0) + 1
        for k in (3, 2, 1):
            self.levels[k] = {}
            for g in self.levels[k + 1]:
                self.levels[k][g[1:]] = self.levels[k].get(g[1:], 0) + 1
        self.off = {}
        for k, level in self.levels.items():
            f = [sum(n == i for n in level.values()) for i in range(1, 5)]
            y = f[0] / (f[0] + 2 * f[1]) if f[0] + 2 * f[1] else 0.5
            self.off[k] = [min(max(i - (i + 1) * y * f[i] / f[i - 1] if f[i - 1] else 0.5 * i, 0.1), i - 0.05) for i in (1, 2, 3)]

    @staticmethod
    def grams(text):
        before = ""
        for w in WORD.findall(text or ""):
            tail = (" " + before)[-2:] if before else "  "
            yield tail + " " + w[0]
            seq = "   " + w + " "
            yield from (seq[i - 3 : i + 1] for i in range(4, len(seq)))
            before = w

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.levels[1]) + 1)
        own = {g: n for g, n in self.levels[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return self.p(gram[1:])
        off, total = self.off[k], sum(own.values())
        n = own.get(gram, 0)
        return (n - off[min(n, 3) - 1] if n else 0) / total + sum(off[min(x, 3) - 1] for x in own.values()) / total * self.p(gram[1:])

    def ln(self, text):
        grams = list(self.grams(text))
        return -sum(math.log(self.p(g)) for g in grams) / len(grams) if grams else None


def test_perplexity_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcdeé日") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(0, 30))) for _ in range(40)] + [None, "", " \n", "zz", "\U0001f600 x"]
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)]
    rows.append(rows[0])
    models = {lang: BruteModel([t for _, t, x in rows if x == lang]) for lang in ("en", "de", None)}
    for m in models.values():
        assert all(abs(sum(m.p(c + x) for x in m.levels[1]) + m.p(c + "\0") - 1) < 1e-9 for c in ("", "a", "ab", "abc", " é "))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for hot, batch, shard in ((400_000, 200_000, 1_000_000), (20, 30, 40), (0, 30, 40)):
        for name, value in (("HOT", hot), ("BATCH", batch), ("SHARD", shard)):
            monkeypatch.setattr(quality_rules, name, value)
        got = quality_rules.judged(df).collect()
        assert len(got) == len(rows)
        for x in got:
            want = models[rows[x.doc_id][2]].ln(texts[x.doc_id])
            assert x.ln_perplexity is None if want is None else x.ln_perplexity == pytest.approx(want, abs=1e-5), texts[x.doc_id]
            assert x.kept == (not x.base_failed and x.low <= x.ln_perplexity <= x.high)


def labelled(spark, n=500):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        w = long_words(1000 + i, 30).split()
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            w.insert(r.randrange(30), r.choice(["idiot", "moron"]))
        if bad:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 7}", 0, "", "", "", ""))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None, None, None, None, None, None, None, None), (None, "", None, None, None, None, None, None, None), (0, rows[0][1], "en", "s0", 0, "", "", "", "")]
    labels += [(10_000, 1, 1), (1, None, None)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark, empty):
    docs, labels = labelled(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert sum((r.doc_id % 4 == 0) == bool(r.predicted) for r in held) / len(held) > 0.95
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count()


def test_quality_classifier(spark, empty):
    docs, labels = labelled(spark)
    rows = quality_classifier.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert sum((r.doc_id % 5 != 0) == r.kept for r in held) / len(held) > 0.95
    assert all(0 < r.path_posterior < 1 and 0 < r.host_posterior < 1 for r in rows)
    assert quality_classifier.quality(empty, labels).count() == 0
    assert quality_classifier.quality(docs, labels.limit(0)).count() == docs.count()


def test_sites_against_closed_form(spark):
    rows = [(i, "big", "x" if i % 3 else "y", 0.9 - i % 7 / 50) for i in range(500)] + [(1000 + i, "low", "x", 0.2) for i in range(500)] + [(2000, "one", "x", 0.05), (2001, "two", "x", 0.3), (2002, "two", "y", 0.8)]
    rows = [(*r, r[3] if r[0] % 5 else float(r[0] % 2)) for r in rows]
    got = {x.doc_id: x for x in quality_classifier.combined(spark.createDataFrame(rows, "doc_id bigint, host string, path string, p double, e double")).collect()}

    def fitted(groups):
        n, x = [len(g) for g in groups], [sum(g) / len(g) for g in groups]
        m = sum(a * b for a, b in zip(n, x)) / sum(n)
        v = sum(a * (b - m) ** 2 for a, b in zip(n, x)) / sum(n) - sum(a * b * (1 - b) / (a + 1) for a, b in zip(n, x)) / sum(n)
        return m, min(max(m * (1 - m) / v - 1, 2.0), 1000.0) if v > 0 else 1000.0

    hosts, paths = {}, {}
    for _, h, s, _, e in rows:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, s), []).append(e)
    (mean, k), (_, k_path) = fitted(list(hosts.values())), fitted(list(paths.values()))
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for d, h, s, p, e in rows:
        host = (k * mean + sum(hosts[h]) - e) / (k + len(hosts[h]) - 1)
        path = (k_path * host + sum(paths[h, s]) - e) / (k_path + len(paths[h, s]) - 1)
        want = 1 / (1 + math.exp(-(odds(p) + odds(path) - odds(mean))))
        assert (got[d].host_posterior, got[d].path_posterior, got[d].score) == pytest.approx((host, path, want), abs=1e-9)
    assert got[2000].path_posterior == pytest.approx(mean)  # a single document has its prior only


def test_learning_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * (i + 1), "x") for i in range(100)] + [(3, "other", "x"), (3, "other", "x"), (None, "n", "x")], "doc_id bigint, text string, _y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 1), (5, None), (3, 0), (None, 1), (500, 1)], "doc_id bigint, toxic int")
    every = common.learning_rows(docs, labels, "toxic", 1000, 10**6, 5).collect()
    assert sorted(r.doc_id for r in every) == [i for i in range(100) if zlib.crc32(str(i).encode()) % 5] and all(r._y == (0 if r.doc_id == 3 else r.doc_id % 2) for r in every)
    some = common.learning_rows(docs, labels, "toxic", 1000, 2000, 5).collect()
    assert 0 < sum(len(r.text) for r in some) <= 2000 and common.learning_rows(docs, labels, "toxic", 7, 10**6, 5).count() == 7


@pytest.mark.parametrize("shard", [2, 50_000])
def test_exact_dedup(docs, empty, shard):
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)

    def want(r):
        ids = groups[r.text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        return str(r.doc_id), str(keep), len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()

    for seen in (F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0):
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, seen, shard).collect())
        assert got == sorted(want(r) for r in rows)
    assert exact_dedup.exact_dedup(empty, F.lit(True)).count() == 0


def test_perfect_hash_is_minimal():
    import numpy as np

    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    h = exact_dedup.PerfectHash(keys[:4000])
    assert sorted(h.slots(keys[:4000]).tolist()) == list(range(4000)) == list(range(len(h)))
    assert ((h.slots(keys[4000:]) >= -1) & (h.slots(keys[4000:]) < 4000)).all()
    assert len(exact_dedup.PerfectHash(keys[:0])) == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "http://net/", "http://net", "https://x.org/fr/a", "http://xorg/fr/", "http://y.example.com/de/", "http://example.net:80/en/", "x://h#/p", "a://b://c/d", "http://q.example.com/\nx"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, None, None, None)], "page_id bigint, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filtered(df).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
        fits = [(r.text, r.verdict) for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert got[i][:3] == (host, path, rule[0]), u
        assert got[i][3] == rule[1] if rule[1] else got[i][3] in ("allow", "block")
    assert url_filter.filtered(df.limit(0)).count() == 0


def test_pipeline(spark, docs, empty, tmp_path):
    import corpus_pipeline as cp

    texts = [long_words(500 + i, 120) for i in range(30)]
    texts += [texts[0], texts[1] + " extra", "too short", long_words(1, 60) + "\n" + texts[2]]
    first = spark.createDataFrame(rows_of(texts), SCHEMA).select(*cp.COLUMNS)
    for start in (first, docs.select(*cp.COLUMNS), empty.select(*cp.COLUMNS)):
        now = start
        for name, stage in cp.STAGES[:-1]:
            now = common.written(stage(spark, now, ""), name)
            assert now.columns == cp.COLUMNS
        assert cp.STAGES[-1][1](spark, now, "").count() == now.count()
    near = {r.doc_id for r in cp.near_stage(spark, first, "").collect()}
    assert near == {*range(30), 32, 33}
    lines = {r.doc_id: r.text for r in cp.line_stage(spark, first, "").collect()}
    assert 30 not in lines and lines[31] == texts[31] and lines[33] == long_words(1, 60) and lines[0] == texts[0]
    good = {r.doc_id for r in cp.quality_stage(spark, first, "").collect()}
    assert 32 not in good and len(good) >= 30
    spark.createDataFrame(rows_of(texts), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 0


def brute_median(values, width):
    bins = sorted(math.floor(v / width) for v in values)
    return (bins[(len(bins) + 1) // 2 - 1] + 0.5) * width


def test_pipeline_against_brute_force(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline as cp

    r = random.Random(21)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = "\n".join(prose(12) for _ in range(5))
    texts = [prose(r.randrange(60, 120)) + "\n" + prose(20) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", texts[2].replace(" ", "  ", 3), texts[3] + "\n" + shared, texts[4] + "\n" + shared, shared, prose(10), "same words here " * 60, None, " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(200))]
    rows = [(i, t, "en" if i % 4 else "de", f"s{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")

    models, judged = {lang: BruteModel([t for _, t, x, _ in rows if x == lang]) for lang in ("en", "de")}, []
    for d, t, lang, _ in rows:
        w = WORD.findall(t or "")
        found = {}
        for k in range(len(w) - 2):
            found.setdefault(tuple(w[k : k + 3]), []).append(k)
        again = {k + j for ks in found.values() if len(ks) > 1 for k in ks for j in range(3)}
        judged.append((d, lang, len(w), len(w) < 50 or 100 * len(again) > 50 * len(w), models[lang].ln(t)))
    band = {}
    for lang in models:
        fine = [(v, n) for _, x, n, failed, v in judged if x == lang and not failed]
        center = brute_median([v for v, _ in fine], quality_rules.BIN)
        band[lang] = center, 1.4826 * brute_median([abs(v - center) * math.sqrt(n) for v, n in fine], quality_rules.BIN)
    now = []
    for (d, t, lang, source), (_, _, n, failed, v) in zip(rows, judged, strict=True):
        center, spread = band[lang]
        unit = spread / math.sqrt(max(n, 1))
        if not failed and center - max(quality_rules.BELOW * unit, quality_rules.MARGIN) <= v <= center + max(quality_rules.ABOVE * unit, quality_rules.MARGIN):
            now.append((d, t, source))
    assert 30 < len(now) < len(rows) - 3
    gone = brute_lines([(d, t) for d, t, _ in now], line_dedup.MIN_WORDS)
    now = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g), s, bool(g)) for (d, t, s), g in zip(now, gone, strict=True)]
    now = [(d, t, s) for d, t, s, lost in now if t or not lost]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (WORD.findall(t) for _, t, _ in now)]
    root = list(range(len(now)))
    for _ in now:
        for a in range(len(now)):
            for b in range(a):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    before, now = len(now), [x for i, x in enumerate(now) if root[i] == i]
    assert len(now) < before
    copies = brute_mix(spark, [(d, s, len(WORD.findall(t))) for d, t, s in now])
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t, _ in now:
        ids = sp.encode(t, add_eos=True)
        want += [(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] * copies[d]
    got = [(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in cp.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_near_stage_reaches_four_fifths(spark):
    import corpus_pipeline as cp

    r, texts = random.Random(11), []
    for i in range(25):
        own = long_words(900 + i, 200).split()
        for changed in (0, 1, 2, 3, 4, 5, 6):
            now = list(own)
            for at in r.sample(range(200), changed):
                now[at] = f"changed{i}x{at}x{changed}"
            texts.append(" ".join(now))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {find(x) for x in range(len(texts))}
    got = {x.doc_id for x in cp.near_stage(spark, spark.createDataFrame(rows_of(texts), SCHEMA).select(*cp.COLUMNS), "").collect()}
    assert got == want and 25 < len(want) < 100


def test_jaccard_links_join_what_all_pairs_join(spark, monkeypatch):
    """Buckets of nodes that link only in part: one node against all others would not find all components."""
    import numpy as np

    r = random.Random(5)
    rows = [[f"w{r.randrange(1 << 60)}" for _ in range(60)] for _ in range(4)]
    texts = []
    for base in rows:
        texts.append(" ".join(base))
        for k in range(40):
            now = list(base)
            for at in r.sample(range(60), k % 4):
                now[at] = f"x{r.randrange(6)}"
            texts.append(" ".join(now))
    sets = {i: x for i, x in enumerate(jaccard.shingle_sets([t.encode() for t in texts]))}
    sizes = np.array([len(x) for x in sets.values()])
    fp = simhash.majority(np.concatenate(list(sets.values())), np.concatenate(([0], np.cumsum(sizes)))).view(np.int64).tolist()
    short = [bytearray(b.tobytes()) for b in jaccard.band_keys(list(sets.values()))[1]]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i: find(i) for i in sets}
    assert 4 < len(set(want.values())) < len(texts)
    classes = spark.createDataFrame([(i, int(sizes[i]), fp[i], short[i]) for i in sets], "node bigint, n bigint, fp bigint, short binary")
    grams = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in sets.items()], "node bigint, grams array<bigint>")
    for block in (7, 2048):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        for keys in (1, 3):  # one bucket of all, and buckets that overlap
            buckets = [(k, i) for i in sets for k in range(keys) if keys == 1 or i % 3 != k or i % 5 == 0]
            got = jaccard.links(spark.createDataFrame(buckets, "key bigint, node bigint"), classes, grams)
            roots = {x.node: x.root for x in components.components(got).collect()}
            assert {i: roots.get(i, i) for i in sets} == want


def test_near_links_compare_each_node_once_a_round(spark, monkeypatch):
    """A group of near copies, many of which resemble no other one: pairs grow with its nodes, and its components are those of all pairs."""
    import numpy as np

    r, base = random.Random(8), long_words(77, 150).split()
    texts = [" ".join(base)]
    for k in range(160):
        now = list(base)
        for at in r.sample(range(150), 2 + k % 8):
            now[at] = f"other{r.randrange(40)}"
        texts.append(" ".join(now))
    asked, linked = [], jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda pairs, classes: (asked.append(pairs.count()), linked(pairs, classes))[1])
    got = {x.doc_id: x.component_id for x in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert asked and max(asked) <= len(texts)
    sets, root = jaccard.shingle_sets([x.encode() for x in texts]), list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = [x if z == y else z for z in root]
    assert got == dict(enumerate(root)) and 20 < len(set(root)) < 140


def test_near_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as cp

    a, b, c, d = (long_words(700 + i, 80) for i in range(4))
    rows = [(1, a), (1, a), (1, b), (2, b), (3, a), (None, c), (None, d), (None, d + " more"), (None, a), (4, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((str(r.doc_id), r.text or "") for r in cp.near_stage(spark, docs, "").collect())
    one_d = [x[1] for x in got if x[1].startswith(d)]
    assert len(one_d) == 1 and got == sorted([("1", a), ("1", b), ("4", ""), ("None", c), ("None", one_d[0])])


def test_near_stage_links_by_golay_codes_of_simhash_fingerprints(spark):
    """Fingerprints and codewords against plain loops; pairs at the least similarity share a key and are within the links' distance."""
    import numpy as np

    def codeword(v):  # that of the twelve upper bits v
        r = v << 11
        for b in range(22, 10, -1):
            r ^= simhash.GOLAY << (b - 11) if r >> b & 1 else 0
        return v << 11 | r

    texts = [long_words(50, 90), long_words(51, 40), "a b c d e f g", "one", "", None]
    rows = {r.doc_id: r for r in jaccard.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, own in enumerate(jaccard.shingle_sets([(t or "").encode() for t in texts])):
        assert rows[i].n == len(own)
        if not len(own):
            assert not rows[i].short and not rows[i].codes
            continue
        sums = []
        for factor in map(int, jaccard._FACTORS):
            hashes = []
            for h in map(int, own):
                x = (h ^ (h >> 32)) * factor % (1 << 64)
                x = (x ^ (x >> 29)) * 0xFF51AFD7ED558CCD % (1 << 64)
                hashes.append(x ^ (x >> 32))
            sums += [sum(1 if h >> b & 1 else -1 for h in hashes) for b in range(64)]
        assert rows[i].short == np.packbits([s > 0 for s in sums]).tobytes()
        codes = np.frombuffer(rows[i].codes, np.uint16).reshape(jaccard.SEGMENTS, 2).tolist()
        for bits, got in list(zip(jaccard._BITS.tolist(), codes, strict=True))[::9]:
            margin = [sums[b] - float(jaccard._EVEN[b]) for b in bits]
            v = sum(1 << k for k, m in enumerate(margin) if m > 0)
            near = [(sum(abs(margin[k]) for k in range(23) if (w ^ v) >> k & 1), w >> 11) for w in map(codeword, range(4096)) if (w ^ v).bit_count() <= 4]
            assert got == ([w for _, w in sorted(near)] + [jaccard._NONE])[:2]
    r = np.random.default_rng(3)
    for n, both in ((300, 267), (27, 24), (9, 8)):
        for _ in range(40):
            h = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2)
            codes, short = jaccard.band_keys([h[:n], h[n - both :]])
            at, keys = jaccard.code_keys(codes, np.array([n, n]))
            assert set(keys[at == 0].tolist()) & set(keys[at == 1].tolist())
            assert jaccard.differing(short[:1], short[1:])[0] <= jaccard.most_bits(np.array([n]))[0]
