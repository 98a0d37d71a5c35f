"""Variant spellings of names typed by people (problem 1).

1. Every mention becomes a party: folded name forms and identifying values.
   Mentions with equal values collapse to one class; only classes are compared.
2. MinHash over padded q-grams of the folded names. A band is joined with an
   identifying value (half of a CNIC, a date of birth, a father's name), so a
   bucket holds only mentions that resemble in name and share a value: a name
   that a third of all rows bear makes no large bucket, and one that is large
   all the same is paired part by part. Only values and names cross the shuffle;
   bands are made where all mentions of a value have met. Firms have no such values; their
   bands are joined with the first letter of a business word. ``bands_for`` takes
   the number of bands from the collision curve 1 - (1 - s^r)^b for the recall
   wanted at similarity s.
3. Candidates are verified by Monge-Elkan similarity together with an exact check
   of CNIC, date of birth and father, where one value may be mistyped. What the
   values say is computed in the JVM and rules out most candidates; the rest are
   compared by name in Arrow batches. Mentions of one exact folded name whose
   bearers nowhere contradict each other are candidates too, and that agreement
   counts as evidence.
4. Star clustering of the links: a centre is better linked than all neighbours
   not yet placed, and its satellites are neighbours of it. Mentions that state
   nothing but a name join a star only if all mentions of that name that do state
   something are in that one star. A link between two stars stays a link.

Cases. Null or empty names have no mention in any pair. Null and '' values are
missing, never equal. Rows repeated under one id are one mention. Ties go to
the smaller key. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import blocks, parties
from sievework.session import reliable

Q = 3


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Fewest bands of ``rows`` hashes that find pairs of this similarity with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


STRONG = (1, bands_for(0.33, 0.95, 1))
# One weak value (part of a date, a year, one word of a father) decides only at a name score of 0.88. Where a part of the
# date and a father's word both agree, ``evidence`` takes names from 0.78, so the two together count as a strong value.
MEDIUM = (3, bands_for(0.5, 0.85, 3))
ALONE = (3, bands_for(0.5, 0.96, 3))
SPECS, PARTIAL = (STRONG, MEDIUM, ALONE), 4
HASHES = max(r * b for r, b in SPECS)
_RNG = np.random.default_rng(11)
# Odd 64-bit multipliers: the product wraps around, so each hash orders the q-grams in its own way.
_A, _B = _RNG.integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1), _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def qgrams(tokens: tuple[str, ...], q: int = Q) -> list[str]:
    """Padded q-grams of the phonetic form of each token, order of tokens ignored."""
    out = set()
    for t in tokens:
        p = "^" + parties.phonetic(t) + "$"
        out.update(p[i : i + q] for i in range(max(1, len(p) - q + 1)))
    return sorted(out)


@lru_cache(maxsize=40_000)
def _sound_signature(sound: str) -> np.ndarray:
    """MinHash values of the padded q-grams of one phonetic form; those of a name are the least of its parts'."""
    p = "^" + sound + "$"
    return signature(sorted({p[i : i + Q] for i in range(max(1, len(p) - Q + 1))}))


def signature(grams: list[str]) -> np.ndarray:
    """MinHash values of a set of q-grams."""
    h = np.fromiter((zlib.crc32(g.encode()) for g in grams), dtype=np.uint64, count=len(grams))
    mixed = h[:, None] * _A[None, :] + _B[None, :]
    return ((mixed ^ (mixed >> np.uint64(32))) * _A[None, ::-1] >> np.uint64(20)).min(axis=0)


def _band(sigs: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """Bucket keys of band number ``at``, from its hashes (one column each) and the values that the names share."""
    out = np.full(len(sigs), at + 1, dtype=np.uint64) * _A[1]
    for r in range(sigs.shape[1]):
        out = (out ^ sigs[:, r]) * _A[0]
        out ^= out >> np.uint64(29)
    made = (out ^ values) * _A[2]
    return (made ^ (made >> np.uint64(31))).view(np.int64)


@lru_cache(maxsize=40_000)
def _value_hash(value: str) -> int:
    return zlib.crc32(value.encode()) << 32 | zlib.crc32(value[::-1].encode() + b"~")


def values_of(p: parties.Party) -> tuple[list[str], list[str], list[str], list[str]]:
    """Identifying values of a party: strong ones, medium ones, the years in which it may have been born, and words of its father."""
    strong, medium, years = [], [], set()
    if p.cnic:
        # The last two are for a slip or a swap in the middle, which spoils both halves.
        strong += [f"c1{p.cnic[:7]}", f"c2{p.cnic[6:]}", f"c3{p.cnic[:5]}{p.cnic[7:]}", f"c4{p.cnic[:6]}{p.cnic[8:]}"]
    for d in p.dobs:
        if "/" in d:
            years.update(str(y) for y in range(int(d[:4]), min(int(d[5:9]), int(d[:4]) + 12) + 1))
            continue
        years.add(d[:4])
        if len(d) == 10:
            y, m, day = d.split("-")
            strong.append(f"d{d}")
            medium += [f"ym{y}{m}", f"yd{y}{day}", f"md{m}{day}"]
            if day <= "12":
                strong.append(f"d{y}-{day}-{m}")
    for f in p.father:
        strong.append("f" + "".join(sorted(parties.phonetic(t) for t in f)))
    dates, words = list(medium), sorted({f"ff{parties.bones(t)}" for f in p.father for t in f})
    strong += [f"{d}|{w}" for d in dates for w in words]
    return strong, medium + words, sorted(years), words


def shared_values(p: parties.Party) -> list[tuple[int, str]]:
    """(value, name): what a party shares a bucket by, with the sounds of one of its names. The lowest bits of a value tell how its
    bands are made (an index of ``SPECS``), and with ``PARTIAL`` that it only pairs with parties of which no full date is known."""
    strong, medium, years, words = values_of(p)
    out = set()
    for form in p.forms:
        name = " ".join(sorted({parties.phonetic(t) for t in form.tokens}))
        if form.firm:
            # Firms often share a town; the first letters of what they do keep them apart.
            wanted = {f"firm{c[0]}": 2 for c in form.business.split()[:2]} or {"firm": 2}
        else:
            wanted = dict.fromkeys(strong, 0) | dict.fromkeys(medium, 1)
            wanted |= {f"y{y}": 1 | PARTIAL for y in years} | {f"y{y}|{w}": 0 | PARTIAL for y in years for w in words}
        out.update(((_value_hash(v) & ~7 | spec) - (1 << 63), name) for v, spec in wanted.items())
    return sorted(out)


def band_keys(values: np.ndarray, name_list: list[str], spec: int) -> Iterator[np.ndarray]:
    """For each band of a spec the bucket keys of all (value, name), computed for one band at a time."""
    rows, bands = SPECS[spec]
    parts = [n.split(" ") for n in name_list]
    codes, sounds = pd.factorize(np.array([t for n in parts for t in n], dtype=object))
    table = np.vstack([*(_sound_signature(t)[: rows * bands] for t in sounds), np.full(rows * bands, ~np.uint64(0))])
    sizes = np.array([len(n) for n in parts])
    at = np.full((len(parts), sizes.max(initial=1)), len(sounds), dtype=np.int32)
    at[np.arange(at.shape[1])[None, :] < sizes[:, None]] = codes
    for band in range(bands):
        cut = np.ascontiguousarray(table[:, band * rows : (band + 1) * rows])
        sigs = cut[at[:, 0]]
        for j in range(1, at.shape[1]):
            np.minimum(sigs, cut[at[:, j]], out=sigs)
        yield _band(sigs, band, values.view(np.uint64))


def block_keys(p: parties.Party) -> tuple[list[int], list[int]]:
    """All bucket keys of one party, and those that only pair it with parties of which no full date is known."""
    keys: tuple[set[int], set[int]] = (set(), set())
    for v, name in shared_values(p):
        for made in band_keys(np.array([v]), [name], v & 3):
            keys[bool(v & PARTIAL)].add(int(made[0]))
    return sorted(keys[0]), sorted(keys[1])


def name_keys(p: parties.Party) -> list[str]:
    """Exact keys of the folded name forms, for mentions that state nothing else."""
    return sorted({("F:" + f.business if f.firm else "P:") + " ".join(sorted(parties.phonetic(t) for t in f.tokens)) for f in p.forms if len(f.tokens) > 1 and all(len(t) > 1 for t in f.tokens)})


# Weights of what CNIC, dates and fathers say, and what a link needs in all.
CNIC_WEIGHT = {"equal": 6.0, "near": 3.5, "differ": -4.0, "missing": 0.0}
DOB_WEIGHT = {"equal": 4.0, "close": 2.5, "partial": 2.0, "weak": -1.5, "differ": -4.0, "missing": 0.0}
FATHER_WEIGHT = {"equal": 3.0, "differ": -2.5, "missing": 0.0}
AGREED, NAMED, LEAST = 2.0, 3.0, 5.0


def decide(weight: float, forms_a, forms_b, fathers_a, fathers_b) -> float:
    """Weight for one identity from that of CNIC and dates: fathers and Monge-Elkan similarity of the names added; -9 where 5 is out of reach."""
    firms = any(f.firm for f in forms_a) and any(f.firm for f in forms_b)
    if firms:
        return 6.0 if parties.name_score(forms_a, forms_b) >= 0.88 else -9.0
    weight += FATHER_WEIGHT[parties.compare_father(fathers_a, fathers_b)]
    if weight + NAMED < LEAST:
        return -9.0
    name = parties.name_score(forms_a, forms_b)
    if name < 0.64:
        return -9.0
    return weight + (NAMED if name >= 0.95 else 2.0 if name >= 0.88 else 1.0 if name >= 0.83 else 0.0 if name >= 0.78 else -1.5)


def decide_many(weight: np.ndarray, forms_a: list, forms_b: list, fathers_a: list, fathers_b: list) -> np.ndarray:
    """``decide`` of each pair; persons are compared by whole batches."""
    firms = [any(f.firm for f in x) and any(f.firm for f in y) for x, y in zip(forms_a, forms_b)]
    out = np.full(len(weight), -9.0)
    for i in (i for i, f in enumerate(firms) if f):
        out[i] = decide(weight[i], forms_a[i], forms_b[i], (), ())
    own = np.array([i for i, f in enumerate(firms) if not f], dtype=np.int64)
    fathers = parties.compare_father_many([fathers_a[i] for i in own], [fathers_b[i] for i in own])
    total = weight[own] + np.array([FATHER_WEIGHT[x] for x in fathers])
    own, total = own[total + NAMED >= LEAST], total[total + NAMED >= LEAST]
    name = parties.name_score_many([forms_a[i] for i in own], [forms_b[i] for i in own])
    said = np.select([name < 0.64, name >= 0.95, name >= 0.88, name >= 0.83, name >= 0.78], [-9.0 - total, NAMED, 2.0, 1.0, 0.0], -1.5)
    out[own] = total + said
    return out


def evidence(a: parties.Party, b: parties.Party) -> float:
    """``decide`` for two parties; 5 or more is one identity."""
    return decide(CNIC_WEIGHT[parties.compare_cnic(a.cnic, b.cnic)] + DOB_WEIGHT[parties.compare_dob(a.dobs, b.dobs)], a.forms, b.forms, a.father, b.father)


def cnic_level(a: Column, b: Column) -> Column:
    """What ``parties.compare_cnic`` says, in the JVM."""
    edits = F.levenshtein(a, b, 2)
    swapped = F.exists(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)), a.substr(i + 2, F.lit(13))) == b)
    near = (edits == 1) | ((edits == 2) & swapped)
    return F.when((a == "") | (b == ""), "missing").when(a == b, "equal").when(near, "near").otherwise("differ")


def dob_level(a: Column, b: Column) -> Column:
    """What ``parties.compare_dob`` says, in the JVM."""
    year, month, day = (lambda d: d.substr(1, 4)), (lambda d: d.substr(6, 2)), (lambda d: d.substr(9, 2))
    last = lambda d: F.when(d.contains("/"), d.substr(6, 4)).otherwise(year(d))

    def level(x: Column, y: Column) -> Column:
        same = sum(((f(x) == f(y)).cast("int") for f in (year, month, day)), F.lit(0))
        crossed = (year(x) == year(y)) & (month(x) == day(y)) & (day(x) == month(y))
        days = F.when(x == y, 4).when((same == 2) | crossed, 3).otherwise(0)
        span = F.when((year(x) <= last(y)) & (year(y) <= last(x)), 2).otherwise(0)
        n = F.least(F.length(x), F.length(y))
        partly = F.when(x.substr(F.lit(1), n) == y.substr(F.lit(1), n), 2).when(F.abs(year(x).cast("int") - year(y).cast("int")) <= 1, 1).otherwise(0)
        return F.when(x.contains("/") | y.contains("/"), span).when((F.length(x) == 10) & (F.length(y) == 10), days).otherwise(partly)

    best = F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: level(x, y)))))
    said = F.element_at(F.array(*[F.lit(k) for k in ("differ", "weak", "partial", "close", "equal")]), best + 1)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "missing").otherwise(said)


def weight_of(level: Column, weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), level)


def classed(rows: DataFrame) -> DataFrame:
    """``rows`` that have names, with rep: the smallest key among those of equal values, which stands for all of them."""
    return rows.filter("size(names) > 0").withColumn("rep", F.min("key").over(Window.partitionBy("kind", "names", "cnic", "dobs", "father")))


def features(reps: DataFrame) -> DataFrame:
    """rep and its folded values; names that fold to nothing drop out."""
    schema = "rep string, forms string, cnic string, dobs array<string>, fathers string, full boolean, stated boolean, firm boolean, name_keys array<string>, father_key string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in (parties.read_party(*r) for r in zip(pdf["rep"], pdf["names"], pdf["cnic"], pdf["dobs"], pdf["father"])):
                if not p.forms:
                    continue
                forms, fathers = parties.pack_party(p)
                full = any(len(d) == 10 for d in p.dobs)
                firm = any(f.firm for f in p.forms)
                father_key = "".join(sorted(parties.phonetic(t) for t in p.father[0])) if p.father else ""
                out.append((p.key, forms, p.cnic, p.dobs, fathers, full, bool(p.cnic or p.dobs or p.father or firm), firm, name_keys(p), father_key))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return reps.select("rep", "names", "cnic", "dobs", "father").mapInPandas(run, schema)


def bucket_rows(feats: DataFrame) -> DataFrame:
    """(v, m, name): a row for each value and name of a class; m is twice its number n, plus 1 where a full date is known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Some twenty rows come of a class: a thousand classes at a time bound what a worker holds.
        for pdf in (whole.iloc[i : i + 1000] for whole in batches for i in range(0, len(whole), 1000)):
            out = []
            for n, full, *r in zip(pdf["n"], pdf["full"], pdf["forms"], pdf["cnic"], pdf["dobs"], pdf["fathers"]):
                m = 2 * n + bool(full)
                out += [(v, m, name) for v, name in shared_values(parties.unpack_party("", *r))]
            yield pd.DataFrame(out, columns=["v", "m", "name"])

    return feats.select("n", "full", "forms", "cnic", "dobs", "fathers").mapInPandas(run, "v bigint, m bigint, name string")


def bucket_pairs(v: np.ndarray, m: np.ndarray, name_list: list[str], most: int = 2_000_000, crowd: int = blocks.CROWD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of the numbers that share a bucket, a < b, of all rows of some values; a bucket of over ``crowd`` rows is paired part by part."""
    numbers, of = np.unique(m >> 1, return_inverse=True)
    full, held, count = (m & 1).astype(bool), [], 0

    def told(x: np.ndarray, y: np.ndarray, partial: bool) -> np.ndarray:
        ok = (of[x] != of[y]) & ~(full[x] & full[y]) if partial else of[x] != of[y]
        x, y = of[x[ok]], of[y[ok]]
        return np.unique(np.minimum(x, y) * len(numbers) + np.maximum(x, y))

    def pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return numbers[codes // len(numbers)], numbers[codes % len(numbers)]

    for kind in np.unique(v & 7):
        own, partial = np.flatnonzero(v & 7 == kind), bool(kind & PARTIAL)
        for keys in band_keys(v[own], [name_list[i] for i in own], int(kind) & 3):
            order = np.argsort(keys, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
            sizes = np.diff(np.append(starts, len(order)))
            rows = own[order]
            for s, n in zip(starts[sizes > crowd], sizes[sizes > crowd]):
                parts = [rows[i : min(i + crowd, s + n)] for i in range(s, s + n, crowd)]
                for i, x in enumerate(parts):
                    for y in parts[i:]:
                        yield pairs(told(np.repeat(x, len(y)), np.tile(y, len(x)), partial))
            few = (sizes > 1) & (sizes <= crowd)
            starts, sizes = starts[few], sizes[few]
            # Each member of a bucket with all that follow it.
            at = np.repeat(starts, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
            after = np.repeat(starts + sizes, sizes) - at - 1
            left = np.repeat(at, after)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
            held.append(told(rows[left], rows[right], partial))
            count += len(held[-1])
            if count > most:
                yield pairs(np.unique(np.concatenate(held)))
                held, count = [], 0
    if held:
        yield pairs(np.unique(np.concatenate(held)))


def candidates(feats: DataFrame, rows: int = 50_000) -> DataFrame:
    """(a, b): numbers n of classes that share a bucket, a < b; a pair may come more than once.

    Values cross the shuffle with the name, not with its bands: buckets are made where all rows of a value have met. The rows of one
    value are held by one worker, some hundred bytes each, and their keys for one band at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def met() -> Iterator[pd.DataFrame]:
            v, m, name = (np.concatenate(c) for c in zip(*held))
            for a, b in bucket_pairs(v, m, name):
                for i in range(0, len(a), 100_000):
                    yield pd.DataFrame({"a": a[i : i + 100_000], "b": b[i : i + 100_000]})

        for pdf in batches:
            v, m, name = (pdf[c].to_numpy() for c in ("v", "m", "name"))
            # Values come in order: all but the last of a batch are complete.
            cut = int(np.searchsorted(v, v[-1])) if len(v) else 0
            if held and len(v) and (cut or held[-1][0][-1] != v[-1]) and sum(len(h[0]) for h in held) + cut >= rows:
                held.append((v[:cut], m[:cut], name[:cut]))
                yield from met()
                held, v, m, name = [], v[cut:], m[cut:], name[cut:]
            if len(v):
                held.append((v, m, name))
        if held:
            yield from met()

    return bucket_rows(feats).repartition("v").sortWithinPartitions("v").mapInPandas(run, "a bigint, b bigint")


def verified(pairs: DataFrame, feats: DataFrame, nicknames: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:
    """(a, b, weight) of the candidates (a, b, agreed) that are one identity."""
    values = feats.select("n", F.struct("forms", "cnic", "dobs", "fathers", "firm").alias("v"))
    wide = pairs.join(values.select(F.col("n").alias("a"), F.col("v").alias("va")).hint("merge"), "a").join(values.select(F.col("n").alias("b"), F.col("v").alias("vb")).hint("merge"), "b")
    said = weight_of(cnic_level(F.col("va.cnic"), F.col("vb.cnic")), CNIC_WEIGHT) + weight_of(dob_level(F.col("va.dobs"), F.col("vb.dobs")), DOB_WEIGHT) + F.when(F.col("agreed"), AGREED).otherwise(0.0)
    # A generator in between: the filter on the weight is not pushed below it, which would compute it twice.
    weighed = wide.select("a", "b", "va", "vb", F.explode(F.array(said)).alias("weight"))
    most = F.col("weight") + NAMED + F.when((F.col("va.fathers") != "") & (F.col("vb.fathers") != ""), FATHER_WEIGHT["equal"]).otherwise(0.0)
    flat = weighed.filter((most >= LEAST) | (F.col("va.firm") & F.col("vb.firm"))).select("a", "b", "weight", *[F.col(f"v{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("forms", "fathers")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parties.use_nicknames(nicknames)
        for pdf in batches:
            cells = ([x(t) for t in pdf[c].tolist()] for x, c in ((parties.unpack_forms, "forms_a"), (parties.unpack_forms, "forms_b"), (parties.unpack_fathers, "fathers_a"), (parties.unpack_fathers, "fathers_b")))
            weight = decide_many(pdf["weight"].to_numpy(dtype=float), *cells)
            yield pdf[["a", "b"]].assign(weight=weight)[weight >= LEAST]

    return flat.mapInPandas(run, "a bigint, b bigint, weight double")


def agreeing_names(feats: DataFrame) -> DataFrame:
    """(a, b): classes of one exact folded name of which all stated CNICs, dates and fathers agree, each with the first of them.

    They need not state the same values (one may give a CNIC, the other a date). One aggregate a name, no pairs inside it.
    """
    days = F.filter("dobs", lambda d: F.length(d) == 10)
    years = F.transform(F.filter("dobs", lambda d: ~d.contains("/")), lambda d: d.substr(1, 4))
    known = feats.filter("NOT firm").select(
        "n", F.nullif("cnic", F.lit("")).alias("c"), F.array_min(days).alias("d1"), F.array_max(days).alias("d2"), F.array_min(years).alias("y1"), F.array_max(years).alias("y2"),
        F.nullif("father_key", F.lit("")).alias("f"), F.explode("name_keys").alias("name_key"),
    )
    ends = [("c", "c"), ("d1", "d2"), ("y1", "y2"), ("f", "f")]
    one = known.groupBy("name_key").agg(F.min("n").alias("b"), F.count("*").alias("size"), *[F.min(a).alias(f"lo_{a}") for a, _ in ends], *[F.max(b).alias(f"hi_{a}") for a, b in ends])
    for a, _ in ends:
        one = one.filter(F.col(f"lo_{a}").isNull() | (F.col(f"lo_{a}") == F.col(f"hi_{a}")))
    return known.join(one.filter("size > 1").select("name_key", "b").hint("merge"), "name_key").filter("n <> b").select(F.least("n", "b").alias("a"), F.greatest("n", "b").alias("b")).distinct()


def star_clusters(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, centre): stars over undirected links; nodes without links are not listed.

    In each round the nodes that rank before all their neighbours (most links, then smaller key) become centres, and the
    neighbours of a centre its satellites (of several centres, of the best-ranked). Placed nodes leave and the rest goes
    on, so each satellite is a neighbour of its centre; a node all of whose neighbours are placed elsewhere is alone.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).filter("x <> y").distinct()
    degree = both.groupBy("x").agg((-F.count("*")).alias("d"))
    ranked = both.join(degree.hint("merge"), "x").join(degree.select(F.col("x").alias("y"), F.col("d").alias("e")).hint("merge"), "y")
    left = reliable(ranked.select(F.struct("d", F.col("x").alias("key")).alias("x"), F.struct(F.col("e").alias("d"), F.col("y").alias("key")).alias("y")))
    nodes = reliable(left.select("x").distinct())
    placed = None
    while True:
        # A node without neighbours left is its own best.
        best = nodes.join(left.groupBy("x").agg(F.min("y").alias("best")).hint("merge"), "x", "left")
        centres = best.filter(F.col("best").isNull() | (F.col("x") < F.col("best"))).select(F.col("x").alias("c"))
        sats = left.join(centres.hint("merge"), left["y"] == centres["c"]).groupBy("x").agg(F.min("c").alias("c"))
        got = reliable(centres.select(F.col("c").alias("x"), "c").unionByName(sats))
        placed = got if placed is None else placed.unionByName(got)
        gone = got.select("x")
        nodes = reliable(nodes.join(gone.hint("merge"), "x", "left_anti"))
        if nodes.isEmpty():
            return placed.select(F.col("x.key").alias("node"), F.col("c.key").alias("centre"))
        left = reliable(left.join(gone.hint("merge"), "x", "left_anti").join(gone.select(F.col("x").alias("y")).hint("merge"), "y", "left_anti"))


def link_names(records: DataFrame, people: DataFrame, dates: DataFrame, nicknames: frozenset[tuple[str, str]] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """(key, kind, n, cluster) of every mention whose identity is known, and the links (a, b) between classes n."""
    rows = reliable(classed(parties.party_rows(records, people, dates)))
    feats = reliable(features(rows.filter("key = rep")).withColumn("n", F.monotonically_increasing_id()))
    met = candidates(feats).withColumn("agreed", F.lit(False)).unionByName(agreeing_names(feats).withColumn("agreed", F.lit(True)))
    links = reliable(verified(met.groupBy("a", "b").agg(F.max("agreed").alias("agreed")), feats, nicknames).select("a", "b"))
    stars = star_clusters(links)
    placed = feats.select("n", "stated", "name_keys").join(stars.select(F.col("node").alias("n"), "centre").hint("merge"), "n", "left")
    placed = reliable(placed.withColumn("centre", F.coalesce("centre", F.when(F.col("stated"), F.col("n")))))
    # A bare name joins the one star of that name; where nobody of that name states anything, bare mentions join each other.
    named = placed.select("n", "stated", "centre", F.explode("name_keys").alias("name_key"))
    by_name = named.groupBy("name_key").agg(F.min("centre").alias("low"), F.max("centre").alias("high"), F.min(F.when(~F.col("stated"), F.col("n"))).alias("bare"))
    unique = by_name.filter("low IS NULL OR low = high").select("name_key", F.coalesce("low", "bare").alias("found"))
    attach = named.filter(~F.col("stated") & F.col("centre").isNull()).join(unique.hint("merge"), "name_key").groupBy("n").agg(F.min("found").alias("found"))
    final = placed.join(attach.hint("merge"), "n", "left").select("n", F.coalesce("centre", "found").alias("c")).filter("c IS NOT NULL")
    numbers = feats.select("n", "rep")
    final = final.join(numbers.select(F.col("n").alias("c"), F.col("rep").alias("cluster")).hint("merge"), "c").join(numbers.hint("merge"), "n").select("n", "rep", "cluster")
    return reliable(rows.select("key", "kind", "rep").join(final.hint("merge"), "rep").select("key", "kind", "n", "cluster")), links


def cluster_pairs(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b): mentions of one star, or of two linked classes, at least one of them an applicant."""
    live = blocks.counted(clusters.select(F.col("cluster").alias("k"), "key", "kind"), 1000)
    inside = blocks.meeting(live.filter("kind = 'A'").drop("kind"), live.drop("kind"), "key").select("a", "b")
    named = clusters.select("n", "key", "kind", "cluster")
    x, y = (named.select(F.col("n").alias(s), F.col("key").alias(f"k{s}"), F.col("kind").alias(f"t{s}"), F.col("cluster").alias(f"c{s}")) for s in "ab")
    across = links.join(x.hint("merge"), "a").join(y.hint("merge"), "b").filter("ca <> cb AND (ta = 'A' OR tb = 'A')").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    both = inside.unionByName(across).filter("a <> b")
    return both.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
