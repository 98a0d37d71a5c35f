"""Names and identifying values of parties: folding, comparison, and their features.

Shared by the linking of typed names (problem 1) and of list records (problem 3).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import normalize_cnic
from sievework.functions.similarity import jaro_winkler, jaro_winkler_codes, letters
from sievework.llm.lookalike import ALIKE, script_of, strip_forms

PARTS = 10  # names of more parts are not compared by batch: the batch would be as wide as the longest
CACHE = 12_000  # entries of each cache of a worker; names repeat within a batch, and a worker's memory is bounded
# Titles that are no part of a name.
TITLES = frozenset("mr mrs ms mst miss dr engr prof haji hafiz malik maalik capt cap captain col colonel maj major gen brig sardar the maulana mufti qari syed sheikh ch chaudhry adv justice retd late alias aka".split())
# Words of business names with their short forms; the first is the full word.
BUSINESS = (
    "limited ltd", "private pvt", "company co coy", "corporation corp corpn", "association assn assoc", "holding hldg hold", "group grp", "enterprises ent entp",
    "industries ind inds", "services serv svcs srv service", "transport transp tpt trans", "logistics log logs", "trading trad trdg trade", "general gen gnl genl",
    "commercial comm coml", "technologies tech techs", "society soc", "educational edu educ", "foundation found fdn fndn", "welfare welf", "trust trst", "relief rlf",
    "exchange exc exch", "money", "changers chgrs", "import imp", "export exp", "international intl int'l", "construction constr", "brothers bros bro", "shipping ship shpg", "marine mar",
    "and",
)
_FULL = {short: words.split()[0] for words in BUSINESS for short in words.split()}
_LEGAL = frozenset("limited private company corporation association holding group and".split())
_RELATION = re.compile(r"\b(?:s\s*/\s*o|d\s*/\s*o|w\s*/\s*o|son of|daughter of|wife of|bin|ibn|bint)\b(.*)$")
# Cyrillic letters to Latin.
_CYRILLIC = dict(zip("абвгдезийклмнопрстуфхцчшщыэюя", "a b v g d e z i i k l m n o p r s t u f kh ts ch sh shch y e yu ya".split()))


def _latin(text: str) -> str:
    """Compatibility forms undone; look-alikes inside Latin words made Latin; Cyrillic words transliterated; accents off."""
    out = []
    for word in strip_forms(text).split():
        scripts = {script_of(c) for c in word} - {""}
        if "Latin" in scripts and len(scripts) > 1:
            word = "".join(c if script_of(c) in ("", "Latin") else next((x for x in ALIKE.get(c, ()) if script_of(x) == "Latin"), c) for c in word)
        elif scripts == {"Cyrillic"}:
            word = "".join(_CYRILLIC.get(c, c) for c in word.lower())
        out.append(word)
    flat = unicodedata.normalize("NFKD", " ".join(out))
    return "".join(c for c in flat if unicodedata.category(c) != "Mn").lower()


@lru_cache(maxsize=2 * CACHE)
def phonetic(token: str) -> str:
    """A token under the spelling habits that typed names vary in: doubled letters, vowels, q/k/c, w/v, ph/f and dropped h."""
    t = re.sub(r"([^aeiou])\1+", r"\1", token)
    for a, b in (("ph", "f"), ("gh", "g"), ("dh", "z"), ("zh", "z"), ("kh", "k"), ("ch", "c"), ("sh", "s"), ("th", "t"), ("x", "ks")):
        t = t.replace(a, b)
    t = t.replace("q", "k").replace("w", "v").replace("ee", "i").replace("ei", "i").replace("ie", "i").replace("oo", "u").replace("ou", "u").replace("uo", "u").replace("y", "i").replace("o", "u")
    t = re.sub(r"c(?![aeiu]|$)", "k", t)
    return re.sub(r"(.)\1+", r"\1", t)


@lru_cache(maxsize=CACHE)
def bones(token: str) -> str:
    """Consonants of the phonetic form, the first letter kept."""
    p = phonetic(token)
    return p[:1] + re.sub(r"[aeiou]", "", p[1:])


class Name(NamedTuple):
    tokens: tuple[str, ...]
    firm: bool
    business: str
    father: tuple[str, ...]


EMPTY = Name((), False, "", ())


@lru_cache(maxsize=CACHE)
def fold_name(text: str) -> Name:
    """The parts of a name: its tokens, whether it is a firm, the codes of its business words, and a father named in it."""
    s = re.sub(r"\bm\s*/\s*s\b", " ", _latin(text or "")).replace("&", " and ").replace("+", " and ")
    father: tuple[str, ...] = ()
    if hit := _RELATION.search(s):
        s, father = s[: hit.start()], tuple(re.findall(r"[a-z0-9]+", hit.group(1)))
    s = re.sub(r"\(\s*r\s*\)", " ", s)
    raw = re.findall(r"[a-z0-9]+", re.sub(r"['`’]", "", s))
    if not raw:
        return Name((), False, "", father)
    business = [_FULL.get(t) for t in raw]
    words = [b for b in business if b and b != "and"]
    capitals = [t for t in raw if 2 <= len(t) <= 5 and not re.search(r"[aeiou]", t)]
    firm = bool(words) and (len(words) > 1 or words[0] in _LEGAL or raw[-1] in _FULL or "the" in raw)
    if not firm and len(raw) >= 3 and re.search(r"\b[A-Z]{2,5}\s*$", strip_forms(text)) and not text.isupper():
        firm, words = True, []
    if firm:
        core, codes = [], []
        for t, b in zip(raw, business):
            if b:
                if b != "and":
                    codes.append(b[:3])
            elif t != "the":
                core.append(t)
        if len(core) > 2 and (not codes or core[-1] in capitals):
            codes, core = [*core[-1], *codes], core[:-1]
        return Name(tuple(core), True, " ".join(codes), ())
    tokens = [t for t in raw if t not in TITLES] or raw
    return Name(tuple(tokens), False, "", father)


_NICKNAMES: frozenset[tuple[str, str]] = frozenset()


def use_nicknames(pairs: frozenset[tuple[str, str]]) -> None:
    """Known short names, as sorted pairs of folded tokens; set once in a worker."""
    global _NICKNAMES
    if pairs != _NICKNAMES:
        _NICKNAMES = pairs
        token_similarity.cache_clear()
        monge_elkan.cache_clear()


def nickname_pairs(forms: DataFrame, most: int = 20_000) -> frozenset[tuple[str, str]]:
    """The table of known short names as token pairs. It is a fixed table; beyond ``most`` rows it is refused, not cut."""
    rows = forms.filter("kind = 'short' AND form IS NOT NULL AND full_form IS NOT NULL").select("form", "full_form").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} known short names")
    pairs = ((fold_name(r["form"]).tokens, fold_name(r["full_form"]).tokens) for r in rows)
    return frozenset(tuple(sorted((a[0], b[0]))) for a, b in pairs if len(a) == 1 and len(b) == 1 and a != b)


@lru_cache(maxsize=4 * CACHE)
def token_similarity(a: str, b: str) -> float:
    """0..1 for two name parts: spelling variants, initials, short forms cut from the front or the end, dropped vowels."""
    if a == b:
        return 1.0
    if a > b:
        return token_similarity(b, a)
    if len(a) == 1 or len(b) == 1:
        return 0.86 if a[0] == b[0] else 0.0
    pa, pb = phonetic(a), phonetic(b)
    if pa == pb:
        return 0.98
    ba, bb = bones(a), bones(b)
    if ba == bb and len(ba) >= 3:
        return 0.95
    if (a, b) in _NICKNAMES:
        return 0.93
    best = jaro_winkler(pa, pb)
    short, long_ = (a, b) if len(a) < len(b) else (b, a)
    if len(short) >= 3 and len(long_) - len(short) >= 2:
        if long_.startswith(short):
            best = max(best, 0.9)
        elif len(short) >= 4 and long_.endswith(short):
            best = max(best, 0.86)
        elif len(short) <= 5 and not re.search(r"[aeiou]", short) and bones(long_).startswith(bones(short)):
            best = max(best, 0.88)
    return best


@lru_cache(maxsize=CACHE)
def monge_elkan(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Monge-Elkan: mean best token similarity, the shorter name weighing more; joined and split parts compared as one string."""
    if not a or not b:
        return 0.0
    if a > b:
        return monge_elkan(b, a)
    s, l = (a, b) if len(a) <= len(b) else (b, a)  # noqa: E741
    up = sum(max(token_similarity(x, y) for y in l) for x in s) / len(s)
    down = sum(max(token_similarity(x, y) for x in s) for y in l) / len(l)
    score = 0.7 * up + 0.3 * down
    if len(s) == 1 < len(l) and len(s[0]) < 6:
        score *= 0.8  # one short word says little about a longer name
    if len(s) != len(l) or score < 0.9:
        ja, jb = phonetic("".join(a)), phonetic("".join(b))
        joined = jaro_winkler(ja, jb)
        if abs(len(ja) - len(jb)) <= 3 and joined >= 0.93:
            score = max(score, joined)
    return score


def _distinct(left: list, right: list) -> tuple[list, np.ndarray]:
    """The different pairs of two lists and the place of each pair among them."""
    seen: dict = {}
    at = np.fromiter((seen.setdefault(p, len(seen)) for p in zip(left, right)), dtype=np.int64, count=len(left))
    return list(seen), at


def _jaro_winkler_pairs(texts: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaro-Winkler of texts[x] and texts[y], those of like length together; long texts, which are few, one by one."""
    out, sizes = np.zeros(len(x)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes, widths, low = letters([t[:40] for t in texts], 40)[0], np.maximum(sizes[x], sizes[y]), 0
    for width in (5, 6, 7, 8, 11, 16, 24, 40):
        own = np.flatnonzero((widths > low) & (widths <= width))
        for at in np.split(own, range(20_000, len(own), 20_000)):
            if len(at):
                out[at] = jaro_winkler_codes(codes[x[at], :width], sizes[x[at]], codes[y[at], :width], sizes[y[at]])
        low = width
    for i in np.flatnonzero(widths > low):
        out[i] = jaro_winkler(texts[x[i]], texts[y[i]])
    return out


def _numbered(items) -> tuple[list, np.ndarray]:
    """The different items and the number of each."""
    seen: dict = {}
    at = [seen.setdefault(t, len(seen)) for t in items]
    return list(seen), np.array(at, dtype=np.int64)


def token_similarity_many(tokens: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``token_similarity`` of tokens[x] and tokens[y] for different tokens: what one token says is computed once, Jaro-Winkler for all pairs at once."""
    rank = np.empty(len(tokens), dtype=np.int64)
    rank[np.array(sorted(range(len(tokens)), key=tokens.__getitem__), dtype=np.int64)] = np.arange(len(tokens))
    # The smaller token on the left, as in ``token_similarity``.
    x, y = np.where(rank[x] <= rank[y], x, y), np.where(rank[x] <= rank[y], y, x)
    sounds, sound = _numbered(map(phonetic, tokens))
    frames, frame = _numbered(map(bones, tokens))
    size, framed = np.array(list(map(len, tokens)), dtype=np.int64), np.array([len(frames[i]) >= 3 for i in frame], dtype=bool)
    first, last = _numbered(t[0] for t in tokens)[1], _numbered(t[-1] for t in tokens)[1]
    bare = np.array([len(t) <= 5 and not re.search(r"[aeiou]", t) for t in tokens], dtype=bool)
    known = {t for p in _NICKNAMES for t in p}
    nick = np.array([t in known for t in tokens], dtype=bool)
    short, long_ = np.where(size[x] < size[y], x, y), np.where(size[x] < size[y], y, x)
    raised = np.zeros(len(x))
    for i in np.flatnonzero((size[short] >= 3) & (size[long_] - size[short] >= 2) & ((first[x] == first[y]) | (last[x] == last[y]) | bare[short])):
        s, l = tokens[short[i]], tokens[long_[i]]  # noqa: E741
        if l.startswith(s):
            raised[i] = 0.9
        elif len(s) >= 4 and l.endswith(s):
            raised[i] = 0.86
        elif bare[short[i]] and frames[frame[long_[i]]].startswith(frames[frame[short[i]]]):
            raised[i] = 0.88
    named = np.zeros(len(x), dtype=bool)
    for i in np.flatnonzero(nick[x] & nick[y]):
        named[i] = (tokens[x[i]], tokens[y[i]]) in _NICKNAMES
    rules = [x == y, (size[x] == 1) | (size[y] == 1), sound[x] == sound[y], (frame[x] == frame[y]) & framed[x], named]
    out = np.select(rules, [1.0, np.where(first[x] == first[y], 0.86, 0.0), 0.98, 0.95, 0.93], -1.0)
    rest = np.flatnonzero(out < 0)
    out[rest] = np.maximum(_jaro_winkler_pairs(sounds, sound[x[rest]], sound[y[rest]]), raised[rest])
    return out


def monge_elkan_many(left: list[tuple[str, ...]], right: list[tuple[str, ...]]) -> np.ndarray:
    """``monge_elkan`` of each pair; each different pair of tokens is compared once. Names of many parts, which are few, one by one."""
    n = len(left)
    many = [max(len(a), len(b)) > PARTS for a, b in zip(left, right)]
    if not n or any(many):
        out, few = np.zeros(n), [i for i in range(n) if not many[i]]
        for i in (i for i in range(n) if many[i]):
            out[i] = monge_elkan(left[i], right[i])
        if few:
            out[few] = monge_elkan_many([left[i] for i in few], [right[i] for i in few])
        return out
    swap = [(len(a), a) > (len(b), b) if len(a) != len(b) else a > b for a, b in zip(left, right)]
    short, long_ = [b if w else a for a, b, w in zip(left, right, swap)], [a if w else b for a, b, w in zip(left, right, swap)]
    codes: dict[str, int] = {}
    grids = []
    for names in (short, long_):
        sizes = np.fromiter(map(len, names), dtype=np.int64, count=n)
        grid = np.full((n, max(1, sizes.max())), -1, dtype=np.int64)
        grid[np.arange(grid.shape[1])[None, :] < sizes[:, None]] = [codes.setdefault(t, len(codes)) for name in names for t in name]
        grids.append((grid, sizes))
    (x, nx), (y, ny) = grids
    both = (x[:, :, None] >= 0) & (y[:, None, :] >= 0)
    low, high = np.minimum(x[:, :, None], y[:, None, :]), np.maximum(x[:, :, None], y[:, None, :])
    met, at = np.unique((low * len(codes) + high)[both], return_inverse=True)
    tokens = list(codes)
    sims = np.full(both.shape, -1.0)
    sims[both] = token_similarity_many(tokens, met // max(1, len(codes)), met % max(1, len(codes)))[at]

    def total(best: np.ndarray, there: np.ndarray) -> np.ndarray:
        # Compensated, as ``sum`` adds: scores lie on the thresholds that they are compared with.
        out, lost = np.zeros(n), np.zeros(n)
        for j in range(best.shape[1]):
            more = np.where(there[:, j], best[:, j], 0.0)
            now = out + more
            lost += np.where(np.abs(out) >= np.abs(more), (out - now) + more, (more - now) + out)
            out = now
        return out + lost

    empty = (nx == 0) | (ny == 0)
    up, down = total(sims.max(2), x >= 0) / np.maximum(nx, 1), total(sims.max(1), y >= 0) / np.maximum(ny, 1)
    score = 0.7 * up + 0.3 * down
    first = np.fromiter((len(s[0]) if s else 0 for s in short), dtype=np.int64, count=n)
    score = np.where((nx == 1) & (ny > 1) & (first < 6), score * 0.8, score)
    asked = np.flatnonzero(~empty & ((nx != ny) | (score < 0.9)))
    # The smaller name on the left, as in ``monge_elkan``.
    joint, number = _numbered(phonetic("".join(name)) for i in asked for name in ((left[i], right[i]) if left[i] <= right[i] else (right[i], left[i])))
    sizes = np.array(list(map(len, joint)), dtype=np.int64)
    ja, jb = number[::2], number[1::2]
    near = np.abs(sizes[ja] - sizes[jb]) <= 3
    joined, at = _jaro_winkler_pairs(joint, ja[near], jb[near]), asked[near]
    score[at] = np.where(joined >= 0.93, np.maximum(score[at], joined), score[at])
    return np.where(empty, 0.0, score)


def business_agree(a: str, b: str) -> str:
    """equal, open (one says nothing or stops earlier, or only the legal form differs) or differ, for codes of business words.

    A code is the start of a word, or one letter of an acronym; the shorter of two codes decides.
    """
    if a == b:
        return "equal"
    x, y = a.split(), b.split()
    if ("imp" in x) != ("imp" in y):
        # The acronym of "import and export" counts the "and".
        x, y = ([c for c in z if c != "a"] if "imp" not in z else z for z in (x, y))
    same = 0
    for p, q in zip(x, y):
        if p[: len(q)] != q[: len(p)]:
            break
        same += 1
    if same == min(len(x), len(y)):
        return "equal" if len(x) == len(y) else "open"
    return "open" if same >= 2 else "differ"


def name_score(forms_a: list[Name], forms_b: list[Name]) -> float:
    """Best similarity of any form of one party with any form of the other; firms and persons never mix."""
    best = 0.0
    for x in forms_a:
        for y in forms_b:
            if x.firm != y.firm:
                continue
            s = monge_elkan(x.tokens, y.tokens)
            if not x.firm and min(len(x.tokens), len(y.tokens)) == 1:
                lone = x.tokens[0] if len(x.tokens) == 1 else y.tokens[0]
                if len(lone) < 10 and max(len(f.tokens) for f in (*forms_a, *forms_b)) > 1:
                    s = min(s, 0.8)  # a short name alone is borne by many
            if x.firm and s > 0.8:
                short, long_ = (x.tokens, y.tokens) if len(x.tokens) <= len(y.tokens) else (y.tokens, x.tokens)
                joined = jaro_winkler(phonetic("".join(short)), phonetic("".join(long_)))
                if joined < 0.93 and min(max(token_similarity(t, u) for u in long_) for t in short) < 0.81:
                    s = 0.8  # one word of a firm's name differs; the other is often just its town
            if x.firm and s > 0:
                s -= {"equal": 0.0, "open": 0.02, "differ": 0.3}[business_agree(x.business, y.business)]
            best = max(best, s)
    return best


def name_score_many(left: list, right: list) -> np.ndarray:
    """``name_score`` of each pair of lists of forms. Firms, which are few, are scored one by one."""
    found, place = _distinct(left, right)
    score, own, x, y, lone = np.zeros(len(found)), [], [], [], []
    for k, (forms_a, forms_b) in enumerate(found):
        if any(f.firm for f in forms_a) and any(f.firm for f in forms_b):
            score[k] = name_score(forms_a, forms_b)
            continue
        longest = max((len(f.tokens) for f in (*forms_a, *forms_b)), default=0)
        for f in forms_a:
            for g in forms_b:
                if not f.firm and not g.firm:
                    a, b = f.tokens, g.tokens
                    own.append(k)
                    x.append(a)
                    y.append(b)
                    lone.append(longest > 1 and min(len(a), len(b)) == 1 and len((a if len(a) == 1 else b)[0]) < 10)
    names, at = _distinct(x, y)
    s = monge_elkan_many([a for a, _ in names], [b for _, b in names])[at]
    np.maximum.at(score, np.array(own, dtype=np.int64), np.where(np.array(lone, dtype=bool), np.minimum(s, 0.8), s))
    return score[place]


def compare_father_many(left: list, right: list) -> list[str]:
    """``compare_father`` of each pair."""
    found, place = _distinct(left, right)
    best, own, x, y = np.full(len(found), -1.0), [], [], []
    for k, (a, b) in enumerate(found):
        for f in a:
            for g in b:
                own.append(k)
                x.append(f)
                y.append(g)
    names, at = _distinct(x, y)
    np.maximum.at(best, np.array(own, dtype=np.int64), monge_elkan_many([a for a, _ in names], [b for _, b in names])[at])
    said = ["missing" if b < 0 else "equal" if b >= 0.87 else "differ" for b in best.tolist()]
    return [said[i] for i in place.tolist()]


def compare_cnic(a: str, b: str) -> str:
    """equal, near (one digit or one swap), differ or missing."""
    if not a or not b:
        return "missing"
    if a == b:
        return "equal"
    wrong = [i for i in range(13) if a[i] != b[i]]
    if len(wrong) == 1 or len(wrong) == 2 and wrong[1] == wrong[0] + 1 and a[wrong[0]] == b[wrong[1]] and a[wrong[1]] == b[wrong[0]]:
        return "near"
    return "differ"


def _compare_date(a: str, b: str) -> int:
    """4 equal days, 3 a slip of the pen apart, 2 agree as far as stated, 1 near years, 0 differ."""
    if len(a) == 10 and len(b) == 10 and "/" not in a + b:
        if a == b:
            return 4
        ya, ma, da = a.split("-")
        yb, mb, db = b.split("-")
        same = (ya == yb) + (ma == mb) + (da == db)
        if same == 2 or (ya == yb and ma == db and da == mb):
            return 3
        return 0
    if "/" in a or "/" in b:
        la, ha = (a[:4], a[-4:]) if "/" in a else (a[:4], a[:4])
        lb, hb = (b[:4], b[-4:]) if "/" in b else (b[:4], b[:4])
        return 2 if la <= hb and lb <= ha else 0
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return 2
    return 1 if a[:4] == b[:4] or abs(int(a[:4]) - int(b[:4])) == 1 else 0


def compare_dob(a: list[str], b: list[str]) -> str:
    """equal, close, partial, weak, differ or missing: the best of all stated dates."""
    if len(a) == 0 or len(b) == 0:
        return "missing"
    return ("differ", "weak", "partial", "close", "equal")[max(_compare_date(x, y) for x in a for y in b)]


def compare_father(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> str:
    """equal, differ or missing."""
    if not a or not b:
        return "missing"
    return "equal" if max(monge_elkan(x, y) for x in a for y in b) >= 0.87 else "differ"


FEATURES = "key string, kind string, names array<string>, cnic string, dobs array<string>, father string"


def party_rows(records: DataFrame | None, people: DataFrame | None, dates: DataFrame) -> DataFrame:
    """(key, kind, names, cnic, dobs, father): one row for each id; equal rows that repeat collapse, and '' counts as null.

    ``dates`` are the standard dates of problem 4 (field_name, row_key, std_value).
    """
    parts = []
    if records is not None:
        parts.append(
            records.select(
                F.col("id").cast("string").alias("key"), F.lit("R").alias("kind"), F.lit("list_records.dob").alias("f"), F.col("id").cast("string").alias("k"),
                F.filter(F.array_union(F.array("primary_name"), F.coalesce("names", F.array().cast("array<string>"))), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "").alias("names"),
                normalize_cnic(F.col("cnic")).alias("cnic"), F.coalesce("father", F.lit("")).alias("father"),
            )
        )
    if people is not None:
        parts.append(
            people.select(
                F.concat(F.lit("APP-"), F.col("id").cast("string")).alias("key"), F.lit("A").alias("kind"), F.lit("applicants.dob").alias("f"), F.col("id").cast("string").alias("k"),
                F.filter(F.array("full_name"), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "").alias("names"),
                normalize_cnic(F.col("cnic")).alias("cnic"), F.coalesce("father_name", F.lit("")).alias("father"),
            )
        )
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    one = rows.filter("key IS NOT NULL").groupBy("key", "kind", "f", "k").agg(F.max(F.struct("names", "cnic", "father")).alias("r"))
    stated = dates.groupBy("field_name", "row_key").agg(F.array_sort(F.collect_set("std_value")).alias("dobs"))
    joined = one.join(stated, (F.col("f") == F.col("field_name")) & (F.col("k") == F.col("row_key")), "left")
    return joined.select("key", "kind", "r.names", "r.cnic", F.coalesce("dobs", F.array().cast("array<string>")).alias("dobs"), "r.father")


class Party(NamedTuple):
    key: str
    forms: list[Name]
    cnic: str
    dobs: list[str]
    father: list[tuple[str, ...]]


def read_party(key: str, names, cnic: str, dobs, father: str) -> Party:
    """The comparable features of a row of ``party_rows``."""
    forms = [n for n in dict.fromkeys(fold_name(x) for x in names) if n.tokens]
    fathers = [fold_name(father).tokens] if father else []
    fathers += [n.father for n in forms if n.father]
    return Party(key, forms, cnic or "", list(dobs), [f for f in dict.fromkeys(fathers) if f and f not in (("na",), ("n", "a"), ("unknown",), ("none",))])


def pack_party(p: Party) -> tuple[str, str]:
    """Folded forms and fathers as texts, so that pairs are compared without folding again."""
    return ";".join(f"{'F' if f.firm else 'P'}|{f.business}|{' '.join(f.tokens)}" for f in p.forms), ";".join(" ".join(f) for f in p.father)


@lru_cache(maxsize=CACHE)
def unpack_forms(text: str) -> tuple[Name, ...]:
    parts = (form.split("|") for form in text.split(";"))
    return tuple(Name(tuple(tokens.split(" ")), kind == "F", business, ()) for kind, business, tokens in parts)


@lru_cache(maxsize=CACHE)
def unpack_fathers(text: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(f.split(" ")) for f in text.split(";")) if text else ()


def unpack_party(key: str, forms: str, cnic: str, dobs, fathers: str) -> Party:
    return Party(key, unpack_forms(forms), cnic, dobs, unpack_fathers(fathers))
