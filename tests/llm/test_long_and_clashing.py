"""Operators on a text of ten megabytes and on one unbroken word, and all beside columns with the names they use themselves."""
import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from domframe.llm import alignment, divergence, exact_dedup, jaccard, line_dedup, mixing, pieces, quality_classifier, quality_rules, secrets, simhash, token_count, toxicity

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the modules use for columns of their own.
CLASHING = "row unit kept host path e node keys _d _h _y p score n at part component size digest term rank pair pairs owner spans line shard fp least grams fame root key quality toxic label rest ids old docs m v value total slot held_out _t _s _r _n _v _m _part upto".split()


def operators(labels):
    """Each operator as a function of documents; its rows are compared."""
    return {
        "op2": simhash.near_duplicates, "op3": line_dedup.line_dedup, "op4": lambda d: token_count.token_counts(d, A_FILE), "op5": mixing.mix_sizes, "op6": quality_rules.judged, "op7": lambda d: toxicity.toxicity(d, labels),
        "op8": lambda d: quality_classifier.quality(d, labels), "op9": lambda d: exact_dedup.exact_dedup(d, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), "op10": lambda d: pieces.encoded(d, B_FILE), "op11": divergence.audit, "op12": secrets.scan,
        "op13": lambda d: alignment.alignment(d, A_FILE, B_FILE), "near": jaccard.near_duplicates,
    }


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def small(spark):
    r = random.Random(3)
    texts = [words(r, n) for n in (80, 200, 60, 120, 90, 70)]
    texts += [texts[0], texts[1] + " tail", texts[2] + "\n" + texts[3], "", None, "short"]
    rows = [(k, t, ["en", "de", None][k % 3], f"s{k % 2}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(12)], "doc_id bigint, quality int, toxic int")


def shown(df):
    return sorted(str([(c, r[c]) for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13", "near"])
def test_clashing_columns(small, labels, name):
    """Columns named like an operator's own change no value of its result, and are not mistaken for them."""
    run = operators(labels)[name]
    wide = small.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHING if c not in small.columns])
    plain, beside = run(small), run(wide)
    own = [c for c in plain.columns if c in beside.columns]
    assert own == plain.columns
    assert shown(plain) == shown(beside.select(*own)) and "clash" not in "".join(shown(beside.select(*own)))


def test_clashing_columns_in_stages(spark, small, tmp_path):
    wide = small.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHING if c not in small.columns])
    for name, stage in corpus_pipeline.STAGES:
        plain, beside = stage(spark, small, str(tmp_path)), stage(spark, wide, str(tmp_path))
        assert plain.columns == beside.columns, name
        assert shown(plain) == shown(beside), name


@pytest.fixture(scope="module")
def long(spark):
    r = random.Random(8)
    lines = [words(r, 12) for _ in range(400)]
    text = "\n".join(r.choice(lines) for _ in range(170_000))
    word = "".join(r.choices("ghijklmnop", k=1_000_000))
    assert len(text) > 10_000_000
    rows = [(1, text, "en", "s1", 0), (2, word, "en", "s1", 0), (3, words(r, 100), "en", "s2", 0), (4, words(r, 100), "de", "s2", 0)]
    return text, word, spark.createDataFrame(rows, DOCUMENTS).repartition(2)


def test_long_texts(spark, long, labels):
    text, word, docs = long
    run = operators(labels)
    got = {n: {r.doc_id: r for r in run[n](docs).collect()} for n in ("op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "near")}
    assert all(set(x) == {1, 2, 3, 4} for x in got.values())
    library = Tokenizer.from_file(A_FILE)
    piece = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    for k, t in ((1, text), (2, word)):
        assert got["op4"][k].n_tokens == len(library.encode(t, add_special_tokens=False).ids) and got["op4"][k].n_bytes == len(t)
        ids = piece.encode(t, add_eos=True)
        assert got["op10"][k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["op9"][k].text_sha256 == hashlib.sha256(t.encode()).hexdigest() and got["op9"][k].group_size == 1
        assert got["op5"][k].size == len(t.split()) and 0 <= got["op7"][k].score <= 1 and 0 <= got["op8"][k].score <= 1
    assert (got["op6"][1].n_words, got["op6"][2].n_words) == (len(text.split()), 1) and got["op6"][1].base_failed and got["op6"][2].base_failed
    assert len({x.component_id for x in got["op2"].values()}) == 4 and len({x.component_id for x in got["near"].values()}) == 4


def test_history_of_all_or_none(spark, small):
    """A side of the comparison without any row."""
    want = shown(exact_dedup.exact_dedup(small, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    for seen in (F.lit(True), F.lit(False)):
        assert shown(exact_dedup.exact_dedup(small, seen)) == want
