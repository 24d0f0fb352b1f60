"""Spelling variants: words within one edit of each other, found by dynamic programming over sorted lists.

words() counts runs of letters over whole texts. Every pair of words one edit apart has its leftmost
difference in the first or the second half of the shorter one; what lies outside that half (the zone) is
equal. So words are dealt by (shorter length, zone, what lies outside), and within a group only the zones'
letters are compared. The group is a sorted list: the row of the edit matrix after d letters is
computed once for all words that share them (the LCP of neighbours says which), only the three
cells beside the diagonal are kept, and a range of words is skipped as soon as every cell of
its shared prefix is over one. All queries of a batch go down the list together, one letter a step.

A group of more than LIMIT words is split: its zone is halved, and halved again, until the groups
are small or the zone is one letter, where a group can't exceed the alphabet. Each pair belongs to the one
zone that holds its leftmost difference, so nothing is counted twice. Tasks hold one group at a
time and return a row for each word, never pairs.

Null texts have no words. A null doc_id is written as nothing before the colon. Repeated rows
count each. Ties of frequency go to the smallest word in code-point order. No words give no
rows; very long words are compared in small batches. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, of, spread

#: Fixed values of the task: letters (as UTF-8, A-Z lower-cased), the damage rate, least size and frequency, dominance.
LETTERS = rb"(?:[a-z]|\xc3[\x80-\xbf])"
RATE, LEAST_LETTERS, LEAST_COUNT, DOMINANT = 199, 6, 5, 5
LIMIT = 200_000  # words of a group before its zone is halved
CELLS = 1 << 20  # letters of a batch
QUERIES = 2048  # of one descent
NONE = np.uint32(0xFFFFFFFF)
KEPT = 100_000  # counts that a task holds before it gives them on


def _counted(rate: int, least: int):
    runs = re.compile(LETTERS + b"{%d,}" % least)

    def run(batches):
        total: Counter = Counter()

        def out():
            found = pa.array([w.decode() for w in total], pa.string())
            return pa.RecordBatch.from_arrays([found, pa.array(total.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                doc = doc.as_py()
                head = zlib.crc32(b"%s:" % ("" if doc is None else str(doc)).encode())
                for word, n in Counter(runs.findall(text.encode().lower())).items():  # bytes.lower() changes A-Z only
                    h = zlib.crc32(word, head)
                    if rate and h % rate == 0:
                        s = word.decode()
                        at = h % len(s)
                        word = (s[:at] + s[at + 1 :]).encode()
                        if len(s) <= least:
                            continue
                    total[word] += n
                if len(total) > KEPT:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return run


def words(docs: DataFrame, rate: int = RATE, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all runs of letters, A-Z lower-cased; of one in `rate` kinds a document, a letter is deleted (0: none)."""
    d = spread(of(docs, doc_id="long", text="string"))
    n = d.mapInArrow(_counted(rate, least_letters), "word string, n long")
    return n.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


KEY = ("m", "a", "c", "head", "tail")


def _zoned(rows: DataFrame) -> DataFrame:
    """rows of (word, n, m, a, c) with what lies before and behind the zone, and the zone's letters."""
    size = F.char_length("word")
    mid = F.col("word").substr(F.col("a") + 1, size - F.col("a") - F.col("c"))
    return rows.select("word", "n", "m", "a", "c", F.col("word").substr(F.lit(1), F.col("a")).alias("head"), F.col("word").substr(size - F.col("c") + 1, F.col("c")).alias("tail"), mid.alias("mid"))


def _halves(a, c, m):
    """The zone from a to m - c (of the shorter word) as its two halves."""
    half = a + F.floor((m - c - a) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), (m - half).alias("c")), F.struct(half.alias("a"), c.alias("c")))


def zones(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row for each word, shorter length and zone: halves, and halves of halves where a group is larger than limit."""
    size = F.char_length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where("m > 0")
    rows = rows.select("word", "n", "m", F.explode(_halves(F.lit(0), F.lit(0), F.col("m"))).alias("z"))
    rows, done = rows.select("word", "n", "m", "z.a", "z.c"), None
    while True:
        zoned = _zoned(rows)
        big = cut(zoned.groupBy(*KEY).count().where((F.col("count") > limit) & (F.col("m") - F.col("a") - F.col("c") > 1)).drop("count"))
        if big.isEmpty():
            return zoned if done is None else done.unionByName(zoned)
        small = zoned.join(big, [*KEY], "left_anti").select(*zoned.columns)
        done = small if done is None else done.unionByName(small)
        rows = zoned.join(big, [*KEY]).select("word", "n", "m", F.explode(_halves(F.col("a"), F.col("c"), F.col("m"))).alias("z"))
        rows = rows.select("word", "n", "m", "z.a", "z.c")


def descend(letters: np.ndarray, first: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) for all rows of a query's group that are exactly one edit from it.

    letters: a row for each word, sorted within its group, ended by at least one 0. first: whether a row begins
    a group. queries: rows to ask for. A frontier entry is a query, a range of rows that share their first
    d letters, and the cells (d, d-1), (d, d), (d, d+1) of its edit matrix, with 2 for more than one.
    """
    n, width = letters.shape
    size = (letters != 0).sum(1)
    same = np.zeros(n, np.int64)  # LCP with the row before
    if n > 1:
        differs = letters[1:] != letters[:-1]
        same[1:] = np.where(differs.any(1), differs.argmax(1), width)
    same[first] = -1
    asked = np.full((n, width + 2), NONE, letters.dtype)  # equal to no letter
    asked[:, :width] = np.where(letters == 0, NONE, letters)
    begins = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    ends = np.append(begins[1:], n)
    found_q, found_w = [], []
    q = queries
    lo, hi = begins[group[q]], ends[group[q]]
    cells = [np.full(len(q), x, np.uint8) for x in (2, 0, 1)]
    for d in range(width):
        starts = np.flatnonzero(same <= d)
        before = np.searchsorted(starts, lo)
        many = np.searchsorted(starts, hi) - before
        parent = np.repeat(np.arange(len(q)), many)
        at = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many) + before[parent]
        lo, hi = starts[at], np.append(starts[1:], n)[at]
        q, (x, y, z) = q[parent], (c[parent] for c in cells)
        letter = letters[lo, d]
        over = letter == 0  # the word ends here: its distance is the cell in the query's last column
        if over.any():
            back = size[q[over]] - d
            near = np.select([back == -1, back == 0, back == 1], [x[over], y[over], z[over]], 2) == 1
            found_q.append(q[over][near])
            found_w.append(lo[over][near])
        differ = [(letter != asked[q, d + k]).astype(np.uint8) if d + k >= 0 else np.uint8(1) for k in (-1, 0, 1)]
        x1 = np.minimum(x + differ[0], y + 1)
        y1 = np.minimum(np.minimum(y + differ[1], z + 1), x1 + 1)
        z1 = np.minimum(z + differ[2], y1 + 1)
        on = (np.minimum(np.minimum(x1, y1), z1) <= 1) & ~over
        q, lo, hi = q[on], lo[on], hi[on]
        cells = [np.minimum(c[on], 2).astype(np.uint8) for c in (x1, y1, z1)]
        if not len(q):
            break
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_w)


def _near_of(t: pa.Table) -> pa.RecordBatch:
    """For whole, sorted groups: each word with near ones, how many there are, and the most frequent."""
    first = np.ones(len(t), bool)
    for c in KEY:
        v = t.column(c)
        differs = pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
        first[1:] = differs if c == KEY[0] else first[1:] | differs
    mids = t.column("mid").to_pylist()
    size = np.fromiter(map(len, mids), np.int64, len(mids))
    letters = np.zeros((len(mids), int(size.max()) + 1), np.uint32)
    letters[np.arange(letters.shape[1]) < size[:, None]] = np.frombuffer("".join(mids).encode("utf-32-le"), np.uint32) + 1
    n, zone, behind = (t.column(c).to_numpy() for c in ("n", "m", "c"))
    zone = zone - t.column("a").to_numpy() - behind  # letters of the shorter word's zone
    short = size == zone
    a, b = [], []
    asked = np.flatnonzero(short)
    for i in range(0, len(asked), QUERIES):
        q, w = descend(letters, first, asked[i : i + QUERIES])
        longer = ~short[w]
        # behind the zone's last letter the difference is the next zone's
        past = longer & (behind[q] > 0)
        if past.any():
            inside = np.arange(letters.shape[1]) < zone[q[past]][:, None]
            past[past] = ((letters[q[past]] == letters[w[past]]) | ~inside).all(1)
        a += [q[~past], w[~past & longer]]
        b += [w[~past], q[~past & longer]]
    names = ["word", "n_near", "form", "form_n"]
    if not a or not sum(map(len, a)):
        return pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.string(), pa.int64(), pa.string(), pa.int64())], names)
    a, b = np.concatenate(a), np.concatenate(b)
    text = t.column("word").to_pylist()
    rank = np.empty(len(text), np.int64)
    rank[sorted(range(len(text)), key=text.__getitem__)] = np.arange(len(text))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    head = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    count = np.diff(np.append(head, len(a)))
    return pa.RecordBatch.from_arrays([pa.array([text[i] for i in a[head]], pa.string()), pa.array(count, pa.int64()), pa.array([text[i] for i in b[head]], pa.string()), pa.array(n[b[head]], pa.int64())], names)


def _scanned(batches):
    """Cuts the sorted rows into batches of whole groups and gives what _near_of finds."""
    held: list[pa.RecordBatch] = []
    cells = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        cells += b.num_rows + sum(len(x) for x in b.column("mid").to_pylist())
        if cells < CELLS:
            continue
        t = pa.Table.from_batches(held)
        last = {c: t.column(c)[-1] for c in KEY}
        of_last = pc.equal(t.column("m"), last["m"])
        for c in KEY[1:]:
            of_last = pc.and_(of_last, pc.equal(t.column(c), last[c]))
        begins = len(t) - int(pc.sum(of_last).as_py())  # the last group may go on in the next batch
        if begins:
            yield _near_of(t.slice(0, begins))
        t = t.slice(begins)
        held, cells = t.to_batches(), 0 if begins else cells // 2
    if held:
        yield _near_of(pa.Table.from_batches(held))


def near_words(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n, n_near, form, form_n) for each row of (word, n): form is the most frequent near word, if any."""
    rows = zones(vocabulary, limit).repartition(*KEY).sortWithinPartitions(*KEY, "mid")
    found = rows.select("word", "n", *KEY, "mid").mapInArrow(_scanned, "word string, n_near long, form string, form_n long")
    both = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", "form", "form_n").unionByName(vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n")))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))).alias("best")
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return out.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def spelling_variants(vocabulary: DataFrame, dominant: int = DOMINANT, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of (word, n), words being distinct.

    form: the most frequent near word, if at least `dominant` times as frequent; root: the end
    of the chain of forms. A form is more frequent than its word, so chains are short (their
    length is the logarithm of the largest count) and doubling their links ends after few joins.
    """
    if dominant < 2:
        raise ValueError("dominant must be 2 or more, or chains could be circles")
    near = near_words(cut(vocabulary.select("word", "n")), limit)
    is_form = F.col("form_n") >= dominant * F.col("n")
    near = cut(near.select("word", "n", "n_near", F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")))
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        stepped = cut(links.join(ahead, links["root"] == ahead["_at"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        links = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    out = near.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
