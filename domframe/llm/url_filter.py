"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

It is fitted on a small labelled table of general words, and on made-up names that stand for words of no list: what it knows
nothing of is allowed. Its bias is set so that of other made-up names at most FALSE_BLOCKS are blocked.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
#: Lengths of n-grams, number of hashed features, penalty, steps and pace of training.
GRAMS, FEATURES, PENALTY, STEPS, PACE, MOMENTUM = (3, 4, 5), 1 << 16, 1e-5, 400, 8.0, 0.9
#: Made-up names in training, others for the bias, and the share of these that may be blocked.
BACKGROUND, CALIBRATION, FALSE_BLOCKS = 2000, 4000, 0.003

#: The labelled table: words of names that are wanted and of those that are not, how hosts and paths are made of them.
WANTED = (
    "museum library school weather cooking garden travel history science music theatre bakery hospital university council archive gallery farm bookshop cinema orchestra village railway harbour mountain forest bicycle football astronomy "
    "physics chemistry biology medicine grammar dictionary recipes poetry painting sculpture architecture engineering software statistics geography language teacher student children parents pottery knitting sailing hiking birds flowers "
    "education nature culture water winter summer letter paper newspaper weekend writing reading building morning evening market street bridge island river ocean animals horses kitchen furniture holiday festival community foundation "
    "institute department research laboratory observatory harvest tradition "
    "bibliothek schule stadt rathaus zeitung garten musik verein kirche wetter reise kunst bahnhof gemeinde handwerk buchhandlung wanderung feuerwehr musee ecole mairie journal jardin histoire voyage cuisine librairie peinture montagne "
    "campagne boulangerie theatre hopital biblioteca ayuntamiento escuela periodico jardin historia viajes cocina musica ciencia hospital teatro montana literatura ciudad pueblo deportes tiempo"
).split()
UNWANTED = (
    "casino viagra cialis pills pharma pharmacy adult porno replica watches porn xxx sex cams escort singles dating betting poker slots jackpot lottery payday loans credit debt crack keygen warez torrent serial ringtones backlinks seo linkfarm clicks traffic "
    "bonus freebets winner prize giveaway miracle diet weightloss steroid kratom bitcoin-doubler fast-cash get-rich cheap-meds buy-followers fake-id clickbait popups adserver spam gambling roulette bets discount-drugs nude erotic"
).split()
PREFIXES, SUFFIXES = ("", "www.", "shop.", "my."), ("com", "org", "net", "edu", "info", "co.uk", "de", "fr")
PLAIN_PATHS = ("/", "/index.html", "/news/2019/05/a.html", "/articles/42", "/about", "/c/list.php", "/images/")
#: Parts of made-up names: a beginning, a vowel, and an end of each syllable.
ONSETS, VOWELS, CODAS = "b c d f g h k l m n p r s t v w z br ch cl dr fl gr kr pl pr sh sl sp st th tr wh".split(), "a e i o u ai ea ee io oo ou".split(), ["", "", "", *"l m n r s t nd ng nt rs st ck".split()]


def training_table() -> list[tuple[str, str, int]]:
    """host, path, 1 for unwanted: each word in a host with each plain path's turn, and in a path below a plain host."""
    out = []
    for unwanted, words in ((0, WANTED), (1, UNWANTED)):
        for i, w in enumerate(words):
            for k in range(3):
                other = words[(7 * i + 3 + k) % len(words)]
                name = (w, f"{w}-{other}", f"{w}{other}")[k]
                out.append((f"{PREFIXES[(i + k) % len(PREFIXES)]}{name}.{SUFFIXES[(i + 2 * k) % len(SUFFIXES)]}", PLAIN_PATHS[(i + k) % len(PLAIN_PATHS)], unwanted))
            host = f"{PREFIXES[i % len(PREFIXES)]}{WANTED[(5 * i) % len(WANTED)]}.{SUFFIXES[i % len(SUFFIXES)]}"
            out.append((host, f"/{w}-{words[(3 * i + 1) % len(words)]}.html", unwanted))
    return out


def made_up(n: int, seed: int, words: list[str] | None = None) -> list[tuple[str, str]]:
    """host and path of n pronounceable names of two to four syllables, with the table's endings and plain paths.

    With words, one of them stands in each url: alone, or beside a made-up name, in the host or in the path.
    """
    r = np.random.default_rng(seed)
    some = lambda parts: parts[int(r.integers(len(parts)))]
    name = lambda: "".join(some(ONSETS) + some(VOWELS) + some(CODAS) for _ in range(int(r.integers(2, 5))))

    def joined(word: str) -> str:
        other = name()
        return some([word, f"{word}-{other}", f"{other}-{word}", word + other, other + word, f"{word}s", f"{other}.{word}"])

    out = []
    for k in range(n):
        host, path = f"{name()}{'-' + name() if r.random() < 0.3 else ''}", some(PLAIN_PATHS) if r.random() < (0.7 if words else 0.5) else f"/{name()}{some("-/")}{name()}.html"
        if words:
            if r.random() < 0.7:
                host = joined(words[k % len(words)])
            else:
                path = f"/{joined(words[k % len(words)])}.html"
        out.append((f"{some(PREFIXES)}{host}.{some(SUFFIXES)}", path))
    return out


def features(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all urls one after the other, and where each url's begin. Host and path have own edges and hashes."""
    parts = [b for h, p in zip(hosts, paths, strict=True) for b in (b"\x02" + h + b"\x03", b"\x04" + p + b"\x05")]
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    part = np.repeat(np.arange(len(parts)), size)
    out, owner = [], []
    for n in GRAMS:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint64(0x100000001B3)
        inside = part[: len(h)] == part[n - 1 :]
        h, of = h[inside], part[: len(inside)][inside]
        h = (h ^ (of.astype(np.uint64) & np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        out.append((h >> np.uint64(40)).astype(np.int64) % FEATURES)
        owner.append(of >> 1)
    if not out:
        return np.zeros(0, np.int64), np.zeros(len(hosts) + 1, np.int64)
    owner, out = np.concatenate(owner), np.concatenate(out)
    order = np.argsort(owner, kind="stable")
    return out[order], np.searchsorted(owner[order], np.arange(len(hosts) + 1))


@lru_cache(1)
def train() -> tuple[np.ndarray, float]:
    """Weights and bias, from the table, from made-up names alone, and from its words among made-up names: full gradient descent with momentum on the mean loss, with a squared penalty. Counts are scaled by length.

    Both classes weigh the same, whatever their numbers of rows. The bias is lowered until made-up names are blocked as
    seldom as FALSE_BLOCKS asks.
    """
    rows = training_table() + [(h, p, 0) for h, p in made_up(BACKGROUND, 1)]
    rows += [(h, p, y) for y, words in ((0, WANTED), (1, UNWANTED)) for h, p in made_up(BACKGROUND, 3 + y, words)]
    at, first = features([h.encode() for h, _, _ in rows], [p.encode() for _, p, _ in rows])
    of = np.repeat(np.arange(len(rows)), np.diff(first))
    value = 1 / np.sqrt(np.diff(first))[of]
    label = np.array([y for _, _, y in rows], float)
    share = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    weight, bias, pull, lean = np.zeros(FEATURES), 0.0, np.zeros(FEATURES), 0.0
    for _ in range(STEPS):
        off = 1 / (1 + np.exp(-(np.bincount(of, weight[at] * value, len(rows)) + bias))) - label
        off *= share
        pull = MOMENTUM * pull + np.bincount(at, off[of] * value, FEATURES) / len(rows) + PENALTY * weight
        lean = MOMENTUM * lean + off.mean()
        weight -= PACE * pull
        bias -= PACE * lean
    others = made_up(CALIBRATION, 2)
    p = scores([h.encode() for h, _ in others], [p.encode() for _, p in others], weight, bias)
    most = np.quantile(p, 1 - FALSE_BLOCKS)
    return weight, float(bias) - max(0.0, float(np.log(most / (1 - most))))


def scores(hosts: list[bytes], paths: list[bytes], weight: np.ndarray, bias: float) -> np.ndarray:
    """Probability of being unwanted; urls without any character have the bias's."""
    at, first = features(hosts, paths)
    z = common.segment_sums(weight[at], first) / np.sqrt(np.maximum(np.diff(first), 1)) + bias
    return 1 / (1 + np.exp(-z))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def filtered(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of pages(page_id, url): page_id, host, path, rule, verdict, score.

    The longest rule that fits decides (of equally long ones the first by code point); else the model's score: 0.5 or more
    is blocked. Null urls and those without "://" have an empty host and path. Rows repeat as in pages; other columns are
    ignored; an empty table gives an empty result. Very long urls are scored whole. The model is fitted on the driver from
    the table above.
    """
    weight, bias = train()
    held = pages.sparkSession.sparkContext.broadcast(weight.astype(np.float32))
    host, path = host_and_path(F.col("url"))
    named = pages.select(F.col("page_id").cast("bigint"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one wins
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("host", "path"))
            p = scores(hosts, paths, held.value, bias)
            said = [v or ("block" if x >= 0.5 else "allow") for v, x in zip(batch.column("verdict").to_pylist(), p, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(said, pa.string()), pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return named.withColumn("rule", rule).withColumn("verdict", verdict).mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, score double")
