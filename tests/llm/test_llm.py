"""Operators tagged llm: brute force, exact round trips and the cases named in their docstrings."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import linkage, lookalike, mixing, names, packing, parties, subjects, survivorship, tokens

PEOPLE = "id long, full_name string, cnic string, father_name string, extra string"
RECORDS = "list string, id string, primary_name string, names array<string>, cnic string, father string, nationality string, key string, a string"
DATES = "field_name string, row_key string, std_value string"


def test_collision_curve():
    for s, recall, rows in ((0.33, 0.95, 1), (0.5, 0.92, 2), (0.7, 0.9, 5)):
        b = names.bands_for(s, recall, rows)
        assert 1 - (1 - s**rows) ** b >= recall > 1 - (1 - s**rows) ** (b - 1)
    # The hashes differ: agreement of two signatures estimates the Jaccard similarity of the q-grams.
    a, b = names.qgrams(("kalbajeet", "huhookhlani")), names.qgrams(("kalbajeet", "roohodteen"))
    jaccard = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((names.signature(a) == names.signature(b)).mean() - jaccard) < 0.15


@pytest.mark.parametrize(
    ("raw", "tokens_", "firm", "father"),
    [
        ("Dr. Ána S/O Bob Lee", ("ana",), False, ("bob", "lee")),
        ("Lee, Ana", ("lee", "ana"), False, ()),
        ("M/s Foo Bar General Trading Co. (Pvt) Ltd", ("foo", "bar"), True, ()),
        ("Khаn", ("khan",), False, ()),
        ("", (), False, ()),
    ],
)
def test_folded_names(raw, tokens_, firm, father):
    n = parties.fold_name(raw)
    assert (n.tokens, n.firm, n.father) == (tokens_, firm, father)


def test_comparisons():
    assert parties.compare_cnic("9000000000001", "9000000000002") == "near" and parties.compare_cnic("", "9") == "missing"
    assert parties.compare_dob(["1970-01-02"], ["1970-02-01"]) == "close" and parties.compare_dob(["1970"], ["1970-05-01"]) == "partial" and parties.compare_dob([], ["1970"]) == "missing"
    assert parties.monge_elkan(("koodkhaa", "yilaani"), ("yilani", "kudkha")) > 0.9 > 0.7 > parties.monge_elkan(("koodkhaa", "yilaani"), ("brimir", "tanov"))


def test_batches_compare_as_single_pairs_do():
    rng, parts = random.Random(9), "ab abd abdul abdulah mohammad muhamad mhmd m k khan kan qhan yilaani yilani hutla hutlaa kudkha koodkhaa rahman rehman ehman".split()
    parties.use_nicknames(frozenset({("khan", "yilani")}))
    try:
        def form():
            tokens_ = tuple(rng.choice(parts) for _ in range(rng.choice([1, 1, 2, 3, 3, 4, 12])))
            if rng.random() < 0.2:
                tokens_ = (*tokens_[:-1], "".join(rng.choice("abdiklmnrsu") for _ in range(rng.choice([3, 9, 60]))))
            return parties.Name(tokens_, rng.random() < 0.15, rng.choice(["", "tra", "tra gen"]), ())

        forms = [tuple(form() for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(3000)]
        fathers = [tuple(form().tokens for _ in range(rng.choice([0, 1, 1, 2]))) for _ in forms]
        weight = np.array([rng.choice([-4.0, 0.0, 2.0, 3.5, 6.0, 10.0]) for _ in forms[1:]])
        x, y, fx, fy = forms[1:], forms[:-1], fathers[1:], fathers[:-1]
        assert parties.name_score_many(x, y).tolist() == [parties.name_score(*p) for p in zip(x, y)]
        assert parties.compare_father_many(fx, fy) == [parties.compare_father(*p) for p in zip(fx, fy)]
        assert linkage.name_patterns(x, y, fx, fy) == [linkage.name_pattern(*p) for p in zip(x, y, fx, fy)]
        assert names.decide_many(weight, x, y, fx, fy).tolist() == [names.decide(*p) for p in zip(weight.tolist(), x, y, fx, fy)]
        assert parties.name_score_many([], []).tolist() == [] == linkage.name_patterns([], [], [], []) == names.decide_many(np.zeros(0), [], [], [], []).tolist()
    finally:
        parties.use_nicknames(frozenset())


def test_linking_typed_names(spark):
    people = [
        (1, "Koodkhaa Hutla Yilaani", "90000-0681838-2", "Boodgazja Neevtesh", "x"), (1, "Koodkhaa Hutla Yilaani", "90000-0681838-2", "Boodgazja Neevtesh", "x"),
        (2, "Hutla Yilani Kudkha", "9000006818382", None, None), (3, "Koodkhaa Hutla Yilaani", "90071-1111222-3", None, None), (4, None, None, None, None), (5, "", "", "", ""),
        (6, "Brimirtan Studragrosl", None, None, None), (7, "Brimirtan Studragrosl", "", "", None),
    ]
    records = [("L", "R1", "KOODKHAA YILAANI", ["KOODKHAA YILAANI", None], "", "Boodgazja Neevtesh", "PK", "k", "a"), ("M", "R2", None, None, None, None, None, None, None)]
    dates = [("applicants.dob", "1", "1970-05-06"), ("list_records.dob", "R1", "1970-05-06"), ("applicants.dob", "3", "1950-01-01")]
    clusters = names.link_names(spark.createDataFrame(records, RECORDS), spark.createDataFrame(people, PEOPLE), spark.createDataFrame(dates, DATES))
    assert {tuple(r) for r in names.cluster_pairs(*clusters).collect()} == {("APP-1", "APP-2"), ("APP-1", "R1"), ("APP-2", "R1"), ("APP-6", "APP-7")}
    none = names.link_names(spark.createDataFrame([], RECORDS), spark.createDataFrame([], PEOPLE), spark.createDataFrame([], DATES))
    assert names.cluster_pairs(*none).count() == 0


def test_candidates_hold_what_evidence_accepts():
    rng, people = random.Random(21), []
    part = lambda: "".join(rng.choice("b d f g k l m n p r s t v z".split()) + rng.choice("aiu") for _ in range(3))
    slip = lambda t: t[: (i := rng.randrange(1, len(t)))] + rng.choice("bdfgklmnprstvz") + t[i + 1 :]
    for k in range(300):
        tokens_, day, father = [part(), part(), part()], f"19{rng.randint(40, 99)}-0{rng.randint(1, 9)}-{rng.randint(13, 28)}", [part(), part()]
        cnic = f"9{rng.randint(0, 10**12 - 1):012d}"
        people.append(parties.read_party(f"a{k}", [" ".join(tokens_)], "" if k % 3 else cnic, [day], " ".join(father)))
        near = cnic[:6] + str((int(cnic[6]) + 1) % 10) + cnic[7:]
        dobs = [] if k % 3 == 0 else [day[:4]] if k % 2 else [f"{int(day[:4]) + 1}{day[4:]}"]
        people.append(parties.read_party(f"b{k}", [" ".join([slip(tokens_[0]), slip(tokens_[1]), slip(tokens_[2])])], "" if k % 3 else near, dobs, "" if k % 3 == 0 else father[0]))
    keys = [tuple(map(set, names.block_keys(p))) for p in people]
    full = [any(len(d) == 10 for d in p.dobs) for p in people]
    true = [(i, j) for i in range(600) for j in range(i) if names.evidence(people[i], people[j]) >= 5]
    met = [(i, j) for i, j in true if keys[i][0] & keys[j][0] or (keys[i][1] & keys[j][1] and not (full[i] and full[j]))]
    assert len(true) > 120 and len(met) >= 0.97 * len(true)


def test_buckets_are_made_after_the_shuffle(spark):
    rng, rows = random.Random(17), []
    part = lambda: "".join(rng.choice("bdgkmnrst") + rng.choice("aiu") for _ in range(2))
    for k in range(400):
        dobs = [[f"197{k % 2}-0{rng.randint(1, 3)}-1{rng.randint(0, 2)}"], [f"197{k % 2}"], [], ["1970/1972"]][rng.randint(0, 3)]
        name = f"{part()} {part()} Trading Company Ltd" if k % 9 == 0 else f"{part()} {part()}"
        rows.append((f"k{k:03d}", [name, part()], f"90000{rng.randint(0, 10**8 - 1):08d}" if k % 4 == 0 else "", dobs, part() if k % 3 else ""))
    reps = spark.createDataFrame(rows, "rep string, names array<string>, cnic string, dobs array<string>, father string")
    feats = names.features(reps).withColumn("n", F.monotonically_increasing_id()).cache()
    keys = {r["n"]: (*map(set, names.block_keys(parties.unpack_party("", r["forms"], r["cnic"], r["dobs"], r["fathers"]))), r["full"]) for r in feats.collect()}
    want = {(a, b) for a in keys for b in keys if a < b and (keys[a][0] & keys[b][0] or keys[a][1] & keys[b][1] and not (keys[a][2] and keys[b][2]))}
    shipped = names.bucket_rows(feats).collect()
    assert len(want) > 500 and {tuple(r) for r in names.candidates(feats).collect()} == {tuple(r) for r in names.candidates(feats, rows=1).collect()} == want
    # A bucket beyond the crowd is paired part by part, and no pair is lost; a few rows a class cross the shuffle, not one a bucket.
    v, m, name = (np.array(c, dtype=t) for c, t in zip(zip(*shipped), (np.int64, np.int64, object)))
    for most, crowd in ((10, 400), (10**6, 3)):
        assert {(a, b) for x, y in names.bucket_pairs(v, m, name, most, crowd) for a, b in zip(x.tolist(), y.tolist())} == want
    assert 4 * len(shipped) < sum(len(a) + len(b) for a, b, _ in keys.values())


def test_stars_end_in_centres(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("a", "b")]
    got = {r["node"]: r["centre"] for r in names.star_clusters(spark.createDataFrame(links, "a string, b string")).collect()}
    linked = {frozenset(p) for p in links}
    assert set(got) == set("abcdxy") and all(got[c] == c for c in got.values()) and got["x"] == got["y"]
    # d hangs on c alone, and c belongs to b: no chain carries d into the star of b.
    assert all(c == n or frozenset((n, c)) in linked for n, c in got.items()) and got["d"] == "d" and got["a"] == got["c"] == "b"
    assert names.star_clusters(spark.createDataFrame([], "a string, b string")).count() == 0


def test_values_weigh_the_same_in_the_jvm(spark):
    rng = random.Random(13)
    numbers = ["", "9000006818382", "9000006818383", "9000006818328", "9000006811238", "9000006181382", "1234567890123"]
    dates = ["1970-01-02", "1970-02-01", "1971-01-02", "1970", "1970-05", "1992/1994", "1993-07-01", "1969", "1950-12-31"]
    pick = lambda: sorted(rng.sample(dates, rng.randint(0, 2)))
    rows = [(rng.choice(numbers), rng.choice(numbers), pick(), pick()) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, x array<string>, y array<string>")
    for r in df.select("*", names.cnic_level(F.col("a"), F.col("b")).alias("c"), names.dob_level(F.col("x"), F.col("y")).alias("d")).collect():
        assert r["c"] == parties.compare_cnic(r["a"], r["b"]) and r["d"] == parties.compare_dob(r["x"], r["y"]), r


def test_expectation_maximisation_separates_levels():
    rng = random.Random(4)
    counts: collections.Counter = collections.Counter()
    truth = {}
    for _ in range(20_000):
        match = rng.random() < 0.1
        name = rng.choices(range(5), (0.01, 0.04, 0.15, 0.3, 0.5) if match else (0.5, 0.3, 0.12, 0.06, 0.02))[0]
        dob = "-" if rng.random() < 0.3 else str(rng.choices((0, 2, 4), (0.05, 0.3, 0.65) if match else (0.9, 0.08, 0.02))[0])
        cnic = "-" if rng.random() < 0.5 else str(rng.choices((0, 2), (0.05, 0.95) if match else (0.99, 0.01))[0])
        key = f"P{name}{dob}{cnic}-"
        counts[key] += 1
        truth.setdefault(key, []).append(match)
    post = linkage.expectation_maximisation(dict(counts), linkage.PERSON_FIELDS)
    error = sum(abs(post[k] - np.mean(v)) * len(v) for k, v in truth.items()) / 20_000
    assert error < 0.05 and post["P442-"] > 0.99 and post["P000-"] < 0.01
    assert linkage.expectation_maximisation({}, linkage.PERSON_FIELDS) == {}


def test_linking_records_of_several_lists(spark):
    def rec(l, i, n, cnic="", father=""):  # noqa: E741
        return (l, i, n, [n], cnic, father, None, None, None)

    rng, rows, dates, truth = random.Random(8), [], [], set()
    syllables = "ba ko ni tu re shi mo ga lu ze da pi vo cha".split()
    for k in range(150):
        name = " ".join("".join(rng.choice(syllables) for _ in range(3)).capitalize() for _ in range(3))
        cnic, day = f"9{rng.randint(0, 10**12 - 1):012d}", f"19{rng.randint(40, 99)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}"
        rows.append(rec("L", f"L{k}", name, cnic if k % 2 else ""))
        dates.append(("list_records.dob", f"L{k}", day))
        if k % 3 == 0:
            rows.append(rec("M", f"M{k}", name.upper().replace("SH", "S"), cnic if k % 4 else ""))
            dates.append(("list_records.dob", f"M{k}", day if k % 5 else day[:4]))
            truth.add((f"L{k}", f"M{k}"))
    rows += [rows[0], rec("N", "N0", ""), ("N", "N1", None, None, None, None, None, None, None)]
    got = linkage.link_records(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(dates, DATES))
    found = {(r["id_a"], r["id_b"]): r["confidence"] for r in got.collect()}
    assert len(truth & set(found)) >= 0.9 * len(truth) and len(set(found) - truth) <= 0.1 * len(truth) and all(0.5 <= c <= 1 for c in found.values())
    assert linkage.link_records(spark.createDataFrame([], RECORDS), spark.createDataFrame([], DATES)).count() == 0


def test_crowded_blocks_are_compared_whole(spark):
    rows = [(i, "LMN"[i % 3] if i % 7 else None, k) for k in (1, 2) for i in range(300 if k == 1 else 60)]
    got = [tuple(r) for r in linkage.block_pairs(spark.createDataFrame(rows, "n long, list string, k long"), crowd=60).collect()]
    of = {key: l for key, l, _ in rows}  # noqa: E741
    want = {(a, b) for a in of for b in of if a < b and of[a] != of[b]}
    assert len(got) == len(set(got)) and set(got) == want
    # Firms state nothing but a name: 70 of one name on two lists are still met.
    firms = [("LM"[i % 2], f"F{i}", "Baldor Trading Company Ltd", ["Baldor Trading Company Ltd"], "", "", None, None, None) for i in range(70)]
    pairs = linkage.link_records(spark.createDataFrame(firms, RECORDS), spark.createDataFrame([], DATES), least=0.0)
    assert pairs.filter("basis = 'pair'").count() == (len(firms) // 2) ** 2


def test_survivorship(spark):
    m = [
        (1, "A", 1, "N/A", "Mayor, Mu...", "PK"), (2, "B", 9, " national ", "Senator, seat 1", "KPK"), (3, "A", 3, "Local", "(vacant)", None), (4, "A", 2, "LOCAL", "Judge", "Sind"),
        (4, "A", 2, "LOCAL", "Judge", "Sind"), (5, "A", 3, "Provincial", "Senator, seat ..", "Punjab"), (6, "A", 1, "Level 2", "", ""),
    ]
    from datetime import datetime

    rows = [(i, l, datetime(2020, 1, t), lv, p, pr, "z") for i, l, t, lv, p, pr in m]  # noqa: E741
    matches = spark.createDataFrame(rows, "match_id long, list string, checked_at timestamp, pep_level string, position string, province string, group_id string")
    groups = spark.createDataFrame([(1, i) for i in range(1, 6)] + [(2, 6), (3, 99)], "group_id long, match_id long")
    lists_ = spark.createDataFrame([("A", "OK", "x"), ("B", "UNVERIFIED", "x")], "list string, status string, match_id string")
    got = survivorship.office_survivors(matches, groups, lists_)
    assert {(r["group_id"], r["field_name"], r["match_id"]) for r in got.collect()} == {(1, "pep_level", 5), (1, "position", 4), (1, "province", 5)}
    assert survivorship.surviving_records(got).first().asDict() == {"group_id": 1, "pep_level": "Provincial", "position": "Judge", "province": "Punjab"}


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Frаnk Lеe", "Frank Lee"), ("Ｆｒａｎｋ", "Frank"), ("Fra​nk", "Frank"), ("Frank Lee", "Frank Lee"), ("José", "José"), ("José", "José"), ("Гридрответ Дровимир", "Гридрответ Дровимир"),
        ("کہےنماان", "کہےنماان"), ("ﬁne", "fine"), ("Гpидpoтвeт Дровимир", "Гридрответ Дровимир"), ("Frank  Lee", "Frank  Lee"), ("", ""), ("x" * 5000 + "а", "x" * 5000 + "a"), ("case ４８７", "case 487"),
    ],
)
def test_lookalikes(raw, clean):
    words = ["frank", "lee", "jose", "fine", "case", "anna"]
    counts: collections.Counter = collections.Counter()
    for script, texts in (("Latin", words * 20), ("Cyrillic", ["гридрответ", "дровимир", "анна", "роман"] * 5)):
        for w in texts:
            for a, b in zip("^" + w, w + "$"):
                counts[script, a, b] += 1
    assert lookalike.Restorer(dict(counts)).text(raw) == clean


def test_lookalike_table(spark):
    rows = [("r1", ["Frаnk", None], None), ("r1", ["Frаnk", None], None), ("r2", None, "plain"), ("r3", [], ""), (None, ["Ｘ"], "Ｘ")]
    df = spark.createDataFrame(rows, "id string, names array<string>, remarks string")
    texts = lookalike.long_texts(df, "id", "names", "n").unionByName(lookalike.long_texts(df, "id", "remarks", "m"))
    got = lookalike.consistent(texts, lookalike.bigram_counts(texts, "text"))
    assert {(r["field_name"], r["row_key"]) for r in got.filter("changed AND row_key IS NOT NULL").collect()} == {("n", "r1")}
    assert got.count() == texts.count()


def test_best_fit_places_every_document_once():
    rng = random.Random(6)
    for cap in (1, 7, 64, 512):
        sizes = [rng.randint(1, cap) for _ in range(900)]
        moves, opened = packing.best_fit(list(collections.Counter(sizes).items()), cap)
        used, seen = collections.Counter(), collections.Counter()
        for size, lo, hi, first, per in moves:
            for r in range(lo, hi):
                used[first + (r - lo) // per] += size
                seen[size] += 1
        assert seen == collections.Counter(sizes) and max(used.values()) <= cap and len(used) == opened
        # Never more containers than best fit one document at a time.
        gaps: list[int] = []
        for s in sorted(sizes, reverse=True):
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is None:
                gaps.append(cap - s)
            else:
                gaps.remove(fit)
                gaps.append(fit - s)
        assert opened <= len(gaps) + 1


def test_packing_round_trip(spark):
    docs = [(i, (i * 37) % 90) for i in range(200)] + [(500, 1000), (500, 1000), (501, 0), (None, 5)]
    caps = spark.createDataFrame([(1, 64), (2, 128), (3, 0)], "capacity_id int, max_tokens int")
    packed = packing.pack(spark.createDataFrame(docs, "doc_id long, tokens long"), caps)
    rows = packed.collect()
    for c, cap in ((1, 64), (2, 128)):
        total, parts, fill = collections.Counter(), collections.defaultdict(list), collections.Counter()
        for r in (r for r in rows if r["capacity_id"] == c):
            total[r["doc_id"]] += r["tokens"]
            parts[r["doc_id"]].append(r["part_no"])
            fill[r["container_id"]] += r["tokens"]
        assert {d: t for d, t in total.items()} == {d: t for d, t in docs if d is not None}
        assert max(fill.values()) <= cap and all(len(p) == 1 for d, p in parts.items() if total[d] <= cap) and len(parts[500]) == -(-1000 // cap)
    assert {r["capacity_id"] for r in rows} == {1, 2}
    assert packing.fills(packed, caps).filter("fill > 1").count() == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long"), caps).count() == 0


def test_mixing_meets_shares_and_caps(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(1, 60)) for i in range(3000)] + [(0, "a", 5), (9001, "b", 0)]
    targets = [(1, "A", 0.5, 2), (1, "b", 0.3, 3), (1, "none", 0.2, 5), (2, "b", 1.0, 1)]
    d, t = spark.createDataFrame(docs, "doc_id long, source string, tokens long"), spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_repeats int")
    share = {(r["mix_id"], r["source"]): r["share"] for r in mixing.shares(d, t).collect()}
    assert abs(share[1, "a"] - 0.625) < 0.01 and abs(share[1, "b"] - 0.375) < 0.01 and share[1, "none"] == 0 and share[2, "b"] == 1
    most = mixing.uses(d, t).groupBy("mix_id", "source").agg(F.max("uses")).collect()
    assert all(m <= {(1, "a"): 2, (1, "b"): 3, (2, "b"): 1}[i, s] for i, s, m in most)
    order = mixing.training_order(d, t).collect()
    assert len(order) == sum(r["uses"] for r in mixing.uses(d, t).collect()) and all(0 <= r["position"] <= 1 for r in order)
    assert mixing.shares(d.limit(0), t).filter("share > 0").count() == 0


def test_tokens_are_whole_texts(spark):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "<|endoftext|>", "x"), (5, "ab " * 30_000, "x")]
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 30_000


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(3)
    words = {"law": "bench writ bail counsel verdict".split(), "sport": "goal wicket match coach stadium".split(), "health": "ward nurse dose fever clinic".split()}

    def text(themes):
        parts = [f"the {rng.choice(words[t])} and the {rng.choice(words[t])} came first." for t in themes for _ in range(3)]
        rng.shuffle(parts)
        return " ".join([*parts, f"someone mentioned the {rng.choice(sum(words.values(), []))} in passing."])

    truth = {i: set(rng.sample(list(words), rng.choice([1, 1, 2]))) for i in range(500)}
    docs = [(i, text(sorted(t)), "news" if i % 3 else None, "en", "k") for i, t in truth.items()] + [(900, None, None, None, None), (901, "", "x", "x", "x")]
    labels = [(i, s, "a") for i in range(300) for s in truth[i] if rng.random() > 0.1] + [(900, "law", "a"), (5, "nonsense", "a"), (None, "law", "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    sub = spark.createDataFrame([(s, "") for s in words], "subject string, description string")
    found = collections.defaultdict(set)
    rows = subjects.subject_areas(d, lab, sub)
    for r in rows.collect():
        found[r["doc_id"]].add(r["subject"])
    held = range(300, 500)
    good = sum(len(found[i] & truth[i]) for i in held)
    assert good / sum(len(found[i]) for i in held) > 0.9 and good / sum(len(truth[i]) for i in held) > 0.9 and not found[900] and not found[901]
    assert {r["subject"] for r in subjects.composition(rows, d).collect()} >= set(words)
    assert subjects.subject_areas(d, lab.limit(0), sub).count() == 0


def test_probabilities_of_subjects_are_shares():
    """Documents whose words the fit has not seen count in the calibration: what is said to be p is so in a share p of unseen documents."""
    rng = random.Random(5)
    word = lambda i: "".join("bdfgklmnpr"[int(d)] + "aeiou"[int(d) % 5] for d in f"{i:05d}")
    words = {"law": [word(i) for i in range(300)], "sport": [word(i) for i in range(300, 40_000)]}

    def document():
        s = "law" if rng.random() < 0.06 else "sport"
        return subjects.features(f"the {rng.choice(words[s])} and a {rng.choice(words[s])} came to {rng.choice('abcdefgh')}one.", "x", "en"), float(s == "law")

    rows, y = zip(*(document() for _ in range(6000)))
    model = subjects.fit_chain(list(rows[:1500]), np.array(y[:1500], dtype=np.float32)[:, None], ["law"])
    z = subjects.Sparse(list(rows[1500:]), model["index"]).times(model["w"])[:, 0] + model["bias"][0]
    p, true = 1 / (1 + np.exp(-(model["a"][0] * z + model["b"][0]))), np.array(y[1500:])
    unsure = p < 0.5
    assert 0.6 < p[unsure].mean() / true[unsure].mean() < 1.6, (p[unsure].mean(), true[unsure].mean())
    assert subjects.platt(np.zeros(3), np.ones(3))[1] > 0 and subjects.platt(np.zeros(0), np.zeros(0)) == (1.0, 0.0)
