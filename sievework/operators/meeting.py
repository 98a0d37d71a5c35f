"""Screening one block of applicants against all list names, in one task and with numpy.

Names arrive as folded parts joined by blanks and become numbers of parts. Pairs of
parts of one side are a sorted index; the other side is looked up in it by the pairs
of its rarest parts (``probes``), each with everything that resembles it. What is
found is scored at once, so a pair of names never leaves the task: only hits do.
List names are taken a chunk at a time, lookups and scores a bounded number at a time,
and hits are held as whole numbers until all names of a record have been met.

Scores equal ``matching.score``, sums in the order of the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sievework.functions import text

# Fixed values of the scoring, and how much is held at a time.
CUTOFF, INITIAL, SUBSET, MAX_EXTRA, EPS = 0.88, 0.9, 88.0, 3, 1e-9
REASONS = ("", "close", "exact", "initials", "subset")
CHUNK, AT_ONCE, HELD = 100_000, 500_000, 2_000_000
LETTERS = 128  # first letters as numbers behind those of the parts; folded parts are ASCII


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within the owner) of each of so many things."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def shares(counts: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of neighbours whose counts sum up to ``limit``, or one alone."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield slice(at, to)
        at = to


class Members:
    """A set of whole numbers with a filter in front: most of what is asked is not in it."""

    def __init__(self, sorted_keys: np.ndarray):
        self.keys, bits = sorted_keys, max(10, min(24, int(np.log2(len(sorted_keys) + 1)) + 4))
        self.shift, self.there = np.uint64(64 - bits), np.zeros(1 << bits, dtype=bool)
        self.there[self._slot(sorted_keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys are there, their places)."""
        maybe = np.flatnonzero(self.there[self._slot(keys)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == keys[maybe]
        return maybe[ok], at[ok]


class Names:
    """Ragged lists of parts."""

    def __init__(self, toks: np.ndarray, sizes: np.ndarray):
        self.toks, self.n = toks, sizes.astype(np.int64)
        self.at = np.cumsum(self.n) - self.n

    def part(self, rows: slice) -> Names:
        first, last = (self.at[rows.start], self.at[rows.stop - 1] + self.n[rows.stop - 1]) if rows.stop > rows.start else (0, 0)
        return Names(self.toks[first:last], self.n[rows])

    def padded(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Parts of the rows, -1 behind the end."""
        place = np.arange(width)
        there = place < self.n[rows][:, None]
        return np.where(there, self.toks[np.where(there, self.at[rows][:, None] + place, 0)], -1)


class Parts:
    """All different parts: number, first letter, length, and what resembles what."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def encode(self, words: pa.Array) -> np.ndarray:
        coded, number = words.dictionary_encode(), self.number
        known = np.fromiter((number.setdefault(w, len(number)) for w in coded.dictionary.to_pylist()), dtype=np.int32, count=len(coded.dictionary))
        return known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, dtype=np.int32)

    def close(self, q: np.ndarray, c: np.ndarray, sim: np.ndarray) -> None:
        """Ends the numbering; (q, c, sim) are the parts of an applicant and of a list that count as alike, each pair once."""
        words = list(self.number)
        self.size = len(words)
        self.letter = np.fromiter((ord(w[0]) for w in words), dtype=np.int64, count=self.size)
        self.single = np.fromiter((len(w) == 1 for w in words), dtype=bool, count=self.size)
        self.soft, self.common = (np.fromiter((w in s for w in words), dtype=bool, count=self.size) for s in (text.SOFT, text.COMMON))
        self.span = self.size + LETTERS
        of_letter = np.full(LETTERS, -1)
        of_letter[self.letter[self.single]] = np.flatnonzero(self.single)
        code = q.astype(np.int64) * self.size + c
        order = np.argsort(code)
        self.near, self.sims = Members(code[order]), sim[order]
        whole, initial = np.flatnonzero(~self.single), np.flatnonzero(self.single)
        own = of_letter[self.letter[whole]]
        self.partners = {
            side: self._lists(np.concatenate([whole, a, whole[own >= 0], initial]), np.concatenate([whole, b, own[own >= 0], self.size + self.letter[initial]]))
            for side, a, b in (("q", q, c), ("c", c, q))
        }

    def _lists(self, of: np.ndarray, partner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=self.size)
        return partner[order], np.cumsum(counts) - counts, counts

    def alike(self, a: np.ndarray, b: np.ndarray, short: np.ndarray, same_letter: np.ndarray) -> np.ndarray:
        """Similarity of parts a of applicants (-1 is none) and b of lists (-2 is none); ``short``: one of them is a letter."""
        out = np.zeros(len(a))
        rest = np.flatnonzero((a >= 0) & (b >= 0) & ~short & (a != b))
        which, at = self.near.find(a[rest] * self.size + b[rest])
        out[rest[which]] = self.sims[at]
        out[short & same_letter] = INITIAL
        out[a == b] = 1.0
        return out


def needed(least):
    """The share of a name that must be covered for a score that rounds to ``least``."""
    return (least - 0.05) / 100


def spare_parts(share, n):
    return np.floor((1 - share) * n + EPS).astype(np.int64)


def only_here(own: np.ndarray, other: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Whether a single part, fully covered, can be matched by a name that is not itself covered to the share needed."""
    found = own > 1
    for k in range(1, int(other[~found].max(initial=0)) + 1):
        rest = np.flatnonzero(~found & (other >= k))
        found[rest] = np.ceil(share[rest] * k - (1 - share[rest]) * own[rest] - EPS) < share[rest] * k - EPS
    return found


class Index:
    """Where pairs of parts, and parts alone, stand in names; a first letter counts as a part of its name."""

    def __init__(self, names: Names, parts: Parts, letters: np.ndarray):
        """``letters``: whether a first letter is asked for at all."""
        owner = np.repeat(np.arange(len(names.n)), names.n)
        first = parts.letter[names.toks]
        asked = letters[first]
        code = np.unique(np.concatenate([owner * parts.span + names.toks, owner[asked] * parts.span + parts.size + first[asked]]))
        owner, part = np.divmod(code, parts.span)
        self.one = self._sorted(part, owner)
        counts, keys, owners = np.bincount(owner, minlength=len(names.n)), [], []
        at = np.cumsum(counts) - counts
        for m in np.unique(counts[counts > 0]):
            rows, (i, j) = np.flatnonzero(counts == m), np.triu_indices(m)
            own = part[at[rows][:, None] + np.arange(m)]
            keys.append((own[:, i] * parts.span + own[:, j]).ravel())
            owners.append(np.repeat(rows, len(i)))
        self.two = self._sorted(np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*owners, np.zeros(0, np.int64)]))

    @staticmethod
    def _sorted(keys: np.ndarray, owners: np.ndarray) -> tuple[Members, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        found, at, counts = np.unique(keys[order], return_index=True, return_counts=True)
        return Members(found), at, counts, owners[order].astype(np.int32)


def probes(names: Names, parts: Parts, side: str, share: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, x, y, level, lone): by which parts each name is looked up; y is -1 for a part alone.

    ``spare`` parts may lack a partner, so of the ``spare`` + 2 rarest two have one: all pairs of those are probes. Where
    there are fewer, each of the ``spare`` + 1 rarest is one alone. Titles that count only with a partner are not looked up
    by, unless no more than two parts are there; a name with nothing else is looked up by every part. ``level`` is what
    must be spare for the probe to be of use, ``lone`` whether the row has probes of one part.
    """
    partner, at, counts = parts.partners[side]
    cost = np.bincount(np.repeat(np.arange(parts.size), counts), weights=df[partner], minlength=parts.size)
    owner, spare = np.repeat(np.arange(len(names.n)), names.n), spare_parts(share, names.n)
    soft = parts.soft[names.toks]
    every = (names.n > 2) & (np.bincount(owner[~soft], minlength=len(names.n)) <= spare)
    kept = np.flatnonzero(~(soft & ((names.n > 2) & ~every)[owner]))
    kept = kept[np.lexsort((cost[names.toks[kept]], owner[kept]))]
    toks, m = names.toks[kept], np.bincount(owner[kept], minlength=len(names.n))
    first, lone = np.cumsum(m) - m, every | (m < spare + 2)
    out = []
    kinds, kind = np.unique(np.stack([m, spare, every]), axis=1, return_inverse=True)
    for k, (size, free, whole) in enumerate(kinds.T):
        rows = np.flatnonzero(kind.ravel() == k)
        rare = toks[first[rows][:, None] + np.arange(size)]
        if whole or size < free + 2:
            i = np.arange(size if whole else min(free + 1, size))
            x, y, level = rare[:, i], np.full((len(rows), len(i)), -1), i * (not whole)
        else:
            i, j = np.triu_indices(free + 2, 1)
            x, y, level = rare[:, i], rare[:, j], j - 1
        out.append((np.repeat(rows, x.shape[1]), x.ravel(), y.ravel(), np.tile(level, len(rows))))
    row, x, y, level = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    return row, x, y, level, lone


def meet(row: np.ndarray, x: np.ndarray, y: np.ndarray, partners: tuple, span: int, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probe, other row) where a partner of each part of a probe stands in the other names."""
    partner, at, counts = partners
    for alone in (False, True):
        own = np.flatnonzero((y < 0) == alone)
        members, starts, many, owners = index.one if alone else index.two
        for s in shares(counts[x[own]] * (1 if alone else counts[y[own]]), AT_ONCE):
            use = own[s]
            if alone:
                p, w = spread(counts[x[use]])
                key = partner[at[x[use[p]]] + w]
            else:
                p, w = spread(counts[x[use]] * counts[y[use]])
                i, j = np.divmod(w, counts[y[use[p]]])
                a, b = partner[at[x[use[p]]] + i], partner[at[y[use[p]]] + j]
                key = np.minimum(a, b) * span + np.maximum(a, b)
            which, place = members.find(key)
            for t in shares(many[place], AT_ONCE):
                o, w = spread(many[place[t]])
                yield use[p[which[t]]][o], owners[starts[place[t]][o] + w]


def score(q: Names, c: Names, qi: np.ndarray, ci: np.ndarray, parts: Parts) -> tuple[np.ndarray, np.ndarray]:
    """(score, number of the reason) of names qi and ci."""
    value, reason = np.zeros(len(qi)), np.zeros(len(qi), dtype=np.int8)
    width = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, *(1 << np.arange(6, 31))])
    wide = lambda x, rows: np.searchsorted(width, x.n[rows])
    kind = wide(q, qi) * 100 + wide(c, ci)
    order = np.argsort(kind, kind="stable")
    for k, first, n in zip(*np.unique(kind[order], return_index=True, return_counts=True)):
        step = max(1, AT_ONCE // int(width[k // 100] * width[k % 100]))
        for at in range(first, first + n, step):
            rows = order[at : min(at + step, first + n)]
            qw, cw = min(width[k // 100], q.n[qi[rows]].max()), min(width[k % 100], c.n[ci[rows]].max())
            value[rows], reason[rows] = _score(q.padded(qi[rows], qw), c.padded(ci[rows], cw), parts)
    return value, reason


def _score(q: np.ndarray, c: np.ndarray, parts: Parts) -> tuple[np.ndarray, np.ndarray]:
    best = {"q": np.zeros(q.shape, order="F"), "c": np.zeros(c.shape, order="F")}
    overlap = np.zeros(len(q), dtype=bool)
    # By columns; what stands behind the end of one side equals nothing of the other.
    side = {s: [(np.where(t >= 0, t, none).astype(np.int64), (t >= 0) & parts.single[t], np.where(t >= 0, parts.letter[t], none)) for t in x.T] for s, x, none in (("q", q, -1), ("c", c, -2))}
    for i, (a, a_single, a_letter) in enumerate(side["q"]):
        for j, (b, b_single, b_letter) in enumerate(side["c"]):
            same_letter = a_letter == b_letter
            sim = parts.alike(a, b, a_single | b_single, same_letter)
            np.maximum(best["q"][:, i], sim, out=best["q"][:, i])
            np.maximum(best["c"][:, j], sim, out=best["c"][:, j])
            overlap |= same_letter
    size, n, w, whole, own, single = {}, {}, {}, {}, {}, {}
    for s, toks in (("q", q), ("c", c)):
        there, hit = toks >= 0, best[s] > 0
        size[s] = there.sum(1)
        kept = (there & (hit | ~parts.soft[toks])).sum(1)
        n[s] = np.where(kept > 1, kept, size[s])
        w[s] = np.zeros(len(toks))
        for i in range(toks.shape[1]):  # in the order of the parts, as the scalar form
            w[s] = w[s] + best[s][:, i]
        whole[s] = (hit | ~there).all(1)
        own[s] = (there & ~parts.common[toks]).any(1)
        single[s] = there & parts.single[toks]
    full = ((c >= 0) & (best["c"] > 0) & ~single["c"]).any(1) | (single["q"].sum(1) == size["q"])
    gate = overlap & full
    value = np.where(gate, np.floor((w["q"] / n["q"] * n["q"] + w["c"] / n["c"] * n["c"]) / (n["q"] + n["c"]) * 1000 + 0.5) / 10, 0.0)
    inside = lambda a, b: (n[a] == size[a]) & (n[a] > 1) & whole[a] & (n[b] - n[a] >= 1) & (n[b] - n[a] <= MAX_EXTRA) & own[a]
    subset = gate & (value < SUBSET) & (inside("q", "c") | inside("c", "q"))
    same = np.zeros(len(q), dtype=bool)
    even = np.flatnonzero(size["q"] == size["c"])
    k = min(q.shape[1], c.shape[1])
    same[even] = (np.sort(q[even], 1)[:, q.shape[1] - k :] == np.sort(c[even], 1)[:, c.shape[1] - k :]).all(1)
    short = single["q"].any(1) | single["c"].any(1)
    reason = np.where(subset, 4, np.where(value <= 0, 0, np.where(same, 2, np.where(short, 3, 1))))
    return np.where(subset, SUBSET, value), reason


def tenths(value: np.ndarray) -> np.ndarray:
    """Scores as whole numbers: they have one decimal."""
    return np.rint(value * 10).astype(np.int16)


def hits(q: Names, least: np.ndarray, c: Names, parts: Parts) -> Iterator[tuple[np.ndarray, ...]]:
    """(q, c, tenths of the score, reason) of all pairs of names with a score of ``least`` of the applicant's name or more; some twice."""
    able = np.flatnonzero(np.isfinite(least))  # without a threshold nothing reaches it
    if len(able) < len(q.n):
        some = Names(q.toks[np.repeat(np.isfinite(least), q.n)], q.n[able])
        yield from ((able[qi], *rest) for qi, *rest in hits(some, least[able], c, parts))
        return
    if not len(q.n) or not len(c.n):
        return
    letters = {s: np.bincount(parts.letter[x.toks[parts.single[x.toks]]], minlength=LETTERS) > 0 for s, x in (("q", q), ("c", c))}

    def frequency(x: Names) -> np.ndarray:
        return np.concatenate([np.bincount(x.toks, minlength=parts.size), np.bincount(parts.letter[x.toks], minlength=LETTERS)])

    q_share, c_share = needed(least), np.full(1, needed(least.min()))
    q_row, qx, qy, q_level, q_lone = probes(q, parts, "q", q_share, frequency(c))
    of_q, q_df = Index(q, parts, letters["c"]), frequency(q)
    for at in range(0, len(c.n), CHUNK):
        rows = slice(at, min(at + CHUNK, len(c.n)))
        some = c.part(rows)
        of_c = Index(some, parts, letters["q"])
        c_row, cx, cy, c_level, _ = probes(some, parts, "c", c_share, q_df)

        def pairs() -> Iterator[np.ndarray]:
            for probe, other in meet(q_row, qx, qy, parts.partners["q"], parts.span, of_c):
                mine = q_row[probe]
                ok = (qy[probe] >= 0) | only_here(q.n[mine], some.n[other], q_share[mine])
                yield mine[ok] * len(some.n) + other[ok]
            for probe, other in meet(c_row, cx, cy, parts.partners["c"], parts.span, of_q):
                mine = c_row[probe]
                ok = (c_level[probe] <= spare_parts(q_share[other], some.n[mine])) & ((cy[probe] >= 0) | q_lone[other] | only_here(some.n[mine], q.n[other], q_share[other]))
                yield other[ok].astype(np.int64) * len(some.n) + mine[ok]

        def scored(held: list[np.ndarray]) -> tuple[np.ndarray, ...]:
            qi, ci = np.divmod(np.unique(np.concatenate(held)), len(some.n))
            value, reason = score(q, some, qi, ci, parts)
            ok = value >= least[qi]
            return qi[ok].astype(np.int32), (ci[ok] + at).astype(np.int32), tenths(value[ok]), reason[ok]

        held, n = [], 0
        for codes in pairs():
            held.append(codes)
            n += len(codes)
            if n > HELD:
                held = [np.unique(np.concatenate(held))]
                n = len(held[0])
                if n > HELD // 2:
                    yield scored(held)
                    held, n = [], 0
        if n:
            yield scored(held)


class Rows:
    """What arrives in a task, batch by batch: names with who bears them."""

    def __init__(self, kind: pa.DataType):
        self.type, self.keys, self.toks, self.n, self.number = kind, [], [], [], []

    def add(self, keys: pa.Array, toks: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> None:
        for held, new in ((self.keys, keys), (self.toks, toks), (self.n, sizes), (self.number, number)):
            held.append(new)

    def done(self) -> tuple[Names, np.ndarray, pa.Array, np.ndarray]:
        """Names, number of the bearer of each, the different bearers, and the number that came with each name."""
        keys = pa.chunked_array(self.keys, type=self.type).combine_chunks()
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        coded = keys.dictionary_encode(null_encoding="encode")
        flat = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
        return Names(flat(self.toks, np.int32), flat(self.n, np.int64)), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, flat(self.number, np.float64)


def first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, first key first, and which places of it begin a new (first key, second key)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    for k, x in enumerate(keys[:2]):
        change = x[order][1:] != x[order][:-1]
        new[1:] = change if k == 0 else new[1:] | change
    return order, new


def best(app: np.ndarray, rec: np.ndarray, ord_: np.ndarray, value: np.ndarray, reason: np.ndarray) -> tuple[np.ndarray, ...]:
    """The best name of each record for each applicant; the first on a tie. ``value`` in tenths."""
    order, new = first_of(app, rec, -value, ord_, -reason.astype(np.int64))
    at = order[new]
    return app[at], rec[at], ord_[at], value[at], reason[at]


# Kinds of rows of a block.
NEAR, APPLICANT, LISTED, SAME, PACKED, RECORD, NUMBER = range(7)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """List names (rec, text, number), a batch of them compressed in one row: every block gets them all."""
    for batch in batches:
        if batch.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["packed"])


def screened(app_type: pa.DataType, rec_type: pa.DataType, ord_type: pa.DataType):
    """A function of the batches of one block to batches of its matches."""
    meet_block = _met(app_type, rec_type, ord_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in meet_block(batches):
            yield from found.combine_chunks().to_batches(max_chunksize=50_000)

    return run


def _met(app_type: pa.DataType, rec_type: pa.DataType, ord_type: pa.DataType):
    """A function of the batches (kind, app, rec, text, other, number) of one block to its matches (app, rec, name_ord, score, reason): a table for each share of the applicants."""
    schema = pa.schema([("app", app_type), ("rec", rec_type), ("name_ord", ord_type), ("score", pa.float64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        parts, near, people, listed, same = Parts(), [], Rows(app_type), Rows(rec_type), []

        def add(to: Rows, keys: pa.Array, names: pa.Array, number: pa.Array) -> None:
            split = pc.split_pattern(names, " ")
            to.add(keys, parts.encode(split.flatten()), pc.list_value_length(split).to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False))

        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            for kind in np.unique(kinds):
                some = batch.filter(pa.array(kinds == kind))
                if kind == SAME:
                    same.append((some.column("app"), some.column("rec")))
                elif kind == NEAR:
                    near.append((parts.encode(some.column("text")), parts.encode(some.column("other")), some.column("number").to_numpy(zero_copy_only=False)))
                elif kind == PACKED:
                    for blob in some.column("packed"):
                        names = pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
                        add(listed, names.column("rec"), names.column("text"), names.column("number"))
                else:
                    to, key = (people, "app") if kind == APPLICANT else (listed, "rec")
                    add(to, some.column(key), some.column("text"), some.column("number"))
        (q, app, apps, least), (c, rec, recs, ord_) = people.done(), listed.done()
        flat = lambda i, kind: np.concatenate([*(x[i] for x in near), np.zeros(0, kind)]).astype(kind)
        parts.close(flat(0, np.int64), flat(1, np.int64), flat(2, np.float64))
        near.clear()
        none = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0, np.int8))
        qi, ci, value, reason = (np.concatenate(x) for x in zip(none, *hits(q, least, c, parts)))
        numbers = tuple(pa.chunked_array([x[k] for x in same], type=kind) for k, kind in ((0, app_type), (1, rec_type)))
        i, j = (pc.index_in(x, value_set=every, skip_nulls=True).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x, every in zip(numbers, (apps, recs)))
        by = {}
        for s, of, n in (("q", app, len(apps)), ("c", rec, len(recs))):
            counts = np.bincount(of, minlength=n)
            by[s] = np.argsort(of, kind="stable"), np.cumsum(counts) - counts, counts
        order = np.argsort(app[qi], kind="stable")
        many = np.bincount(app[qi], minlength=len(apps))
        at = 0
        for some in shares(many + 1, AT_ONCE):
            rows = order[at : at + many[some].sum()]
            at += len(rows)
            found = best(app[qi[rows]], rec[ci[rows]], ord_[ci[rows]], value[rows], reason[rows])
            mine = np.flatnonzero((i >= some.start) & (i < some.stop))
            rest = mine[~((j[mine] >= 0) & np.isin(i[mine] * (len(recs) + 1) + j[mine], found[0] * (len(recs) + 1) + found[1]))]
            named, bare = rest[j[rest] >= 0], rest[j[rest] < 0]
            other = numbered(i[named], j[named], by, rec, app, ord_, q, c, parts)
            yield pa.concat_tables([
                table_of(*(x.take(pa.array(k)) for x, k in ((apps, np.append(found[0], other[0])), (recs, np.append(found[1], other[1])))), *(np.append(x, y) for x, y in zip(found[2:], other[2:]))),
                table_of(*(x.take(pa.array(bare)) for x in numbers), *(np.zeros(len(bare), np.int64),) * 3),
            ])

    def numbered(i, j, by, rec, app, ord_, q, c, parts):
        """The best name for pairs of one number that were not found by name: every pair of their names is scored, whatever the score."""
        (qo, qs, qn), (co, cs, cn) = by["q"], by["c"]
        p, w = spread(qn[i] * cn[j])
        x, y = np.divmod(w, cn[j[p]])
        qi, ci = qo[qs[i[p]] + x], co[cs[j[p]] + y]
        value, reason = score(q, c, qi, ci, parts)
        # Without a score the first place, 0, stands for all names; anything above 0 comes before it.
        zero = value <= 0
        return best(app[qi], rec[ci], np.where(zero, 0, ord_[ci]), np.where(zero, 0, tenths(value)), np.where(zero, 0, reason))

    def table_of(app, rec, ord_, value, reason):
        return pa.table([app, rec, pa.array(ord_).cast(ord_type), pa.array(value / 10.0), pa.array(REASONS, pa.string()).take(pa.array(reason.astype(np.int64)))], schema=schema)

    return run


def places(*keys: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(place from 1, size of the group) of each row within its group, of the first ``groups`` keys, by the order of all keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for x in keys[:groups]:
        new[1:] |= x[order][1:] != x[order][:-1]
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    place, size = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    place[order], size[order] = spread(sizes)[1] + 1, np.repeat(sizes, sizes)
    return place, size


def reported(app_type: pa.DataType, rec_type: pa.DataType, ord_type: pa.DataType, sources: tuple[str, ...], k: int = 50):
    """As ``screened``, to the first k records of each applicant and source: those of one number first, then by score and record.

    Rows of kind RECORD (rec, text: source, other: number) and NUMBER (app, other: number) say what that needs; without them a match
    is left out. ``total`` is the true number of the source, ``in_case`` whether a row is among the first k of all sources.
    """
    meet_block = _met(app_type, rec_type, ord_type)
    schema = pa.schema([("app", app_type), ("source", pa.string()), ("rec", rec_type), ("score", pa.float64()), ("reason", pa.string()), ("by_cnic", pa.bool_()), ("place", pa.int32()), ("total", pa.int64()), ("in_case", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {RECORD: [], NUMBER: []}
        codes = lambda x: x.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)

        def names() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch.column("kind").to_numpy(zero_copy_only=False)
                for x, some in held.items():
                    if (kinds == x).any():
                        some.append(batch.filter(pa.array(kinds == x)))
                yield batch.filter(pa.array(kinds < RECORD))

        records = None
        for found in meet_block(names()):
            if not (held[RECORD] and held[NUMBER]):
                return
            if records is None:
                records, numbers = (pa.Table.from_batches(x).combine_chunks() for x in held.values())
                both = codes(pa.chunked_array([*numbers["other"].chunks, *records["other"].chunks, pa.array([""], pa.string())]))
                source, position = codes(records["text"]), pc.index_in(records["text"], value_set=pa.array(sources)).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
                rank = np.empty(records.num_rows, np.int64)
                rank[pc.sort_indices(records["rec"]).to_numpy()] = np.arange(records.num_rows)
            at = lambda x, every: pc.index_in(x, value_set=every.combine_chunks(), skip_nulls=True).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            rec, app = at(found["rec"], records["rec"]), at(found["app"], numbers["app"])
            known = np.flatnonzero((rec >= 0) & (app >= 0))
            found, rec, app = found.take(pa.array(known)), rec[known], app[known]
            mine = both[: numbers.num_rows][app]
            by = (mine == both[numbers.num_rows : -1][rec]) & (mine != both[-1])
            score = found["score"].to_numpy()
            place, total = places(app, source[rec], ~by, -score, rank[rec], groups=2)
            top = np.flatnonzero(place <= k)
            over_all, _ = places(app[top], ~by[top], -score[top], position[rec[top]], place[top], groups=1)
            found, stated = found.take(pa.array(top)), records["text"].take(pa.array(rec[top]))
            own = [pa.array(x, kind) for x, kind in ((by[top], pa.bool_()), (place[top], pa.int32()), (total[top], pa.int64()), (over_all <= k, pa.bool_()))]
            yield from pa.table([found["app"], stated, found["rec"], found["score"], found["reason"], *own], schema=schema).combine_chunks().to_batches(max_chunksize=50_000)

    return run
