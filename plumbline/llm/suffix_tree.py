"""Language-model scoring with a probabilistic suffix tree over words.

The root is the smoothed unigram distribution of all training words.  Below it are
contexts of one to `depth` preceding words.  A context is a candidate if it occurs often
enough.  A word after it is stored if it comes more often than the context's longest
retained suffix predicts (its share of the likelihood ratio reaches GAIN), and the context
is retained if all it stores diverges from the prediction (a likelihood-ratio test).  After
a retained context s, each stored word w has probability

    c(s, w) / (c(s) + kappa)  +  (1 - stored mass of s) * P(w | suffix of s)

so the distributions sum to one and give no word zero.  A text is scored with the
longest retained suffix at every word.

grow() makes the tree that grows with the corpus: candidates by an absolute number of
occurrences, all of them in tables.  As every suffix of a stored pair is stored, the log
probability of a text is its unigram one and a weight for each run of words in it:

    log rest(s) for each retained context, log(1 + mass / (rest(s) * P(w | suffix of s)))
    for each stored pair (s, w)

so the most frequent runs are looked up in the executors, and all others are joined.
What is sent is bounded (TOP words, HOT runs, twice 2^26 bits that tell runs without a
weight); the bits only save rows, and no result depends on them.

train() makes a tree in memory, of contexts that make up p_min of the training words.
Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textscan as ts
from plumbline.llm.session import Scratch, ship, written

TOP = 1 << 17
HOT = 1 << 22
GAIN = 10.83  # chi square of one degree of freedom, exceeded by chance once in a thousand
END = np.uint64(0x454E44)
_FLUSH = 1 << 21
_SLOTS = 20  # log2 of the 64-bit slots of a filter
_GRID = float(1 << 26)  # weights are whole multiples of its inverse, so sums do not depend on the order


@dataclass
class Level:
    """The candidate contexts of one length, and what is stored after those retained."""

    contexts: np.ndarray  # sorted: context of the words before the last * TOP + last word
    words: np.ndarray  # (contexts, length): positions in the list of top words
    counts: np.ndarray
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))  # mass left to the suffix
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # sorted: context * TOP + word
    mass: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Tree:
    total: int
    distinct: int
    hashes: np.ndarray  # of the top words, sorted
    counts: np.ndarray
    levels: list[Level]

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))


def _tokens(part: ts.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END after each document, and each document's first token (n_docs + 1)."""
    starts, ends, first = part.words()
    h = ts.span_hashes(part.buf, starts, ends)
    return np.insert(h, first[1:], END), first + np.arange(part.n_docs + 1)


def _find(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value is in a sorted array; -1 where it is not."""
    if not len(sorted_):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def _contexts(word: np.ndarray, first: np.ndarray, levels: list[Level]) -> Iterator[np.ndarray]:
    """For each level, the number of the candidate context before every token; -1 for none."""
    now = np.zeros(len(word), dtype=np.int64)  # the empty context
    for level in levels:
        code = np.where((now[:-1] >= 0) & (word[:-1] >= 0), now[:-1] * TOP + word[:-1], -1)
        now = np.concatenate([[-1], _find(level.contexts, code)])
        now[first[:-1]] = -1
        yield now


def _count(batches: Iterator[pa.RecordBatch], value) -> Iterator[pa.RecordBatch]:
    """Counts of value(slice), one long a thing, in runs."""
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        things, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(things.view(np.int64)), pa.array(counts)], names=["thing", "n"])

    for batch in batches:
        for part in ts.slices(batch.column(0), lower=True):
            held.append(value(part))
            n += len(held[-1])
            if n >= _FLUSH:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def _counts(texts: DataFrame, value) -> DataFrame:
    return texts.mapInArrow(lambda b: _count(b, value), "thing long, n long").groupBy("thing").agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame) -> list[np.ndarray]:
    got = df.toArrow()
    return [np.asarray(c.combine_chunks()) if c.num_chunks else np.zeros(0, dtype=np.int64) for c in got.columns]


def _root(texts: DataFrame) -> tuple[Tree, DataFrame]:
    """The root of the tree, and the table of all training words."""
    ship(texts.sparkSession)
    vocabulary = written(_counts(texts, lambda part: _tokens(part)[0]), "vocabulary")
    total, distinct = vocabulary.agg(F.sum("n"), F.count("*")).first()
    top, counts = _most(vocabulary, TOP, "thing", "n")
    hashes = top.view(np.uint64)
    order = np.argsort(hashes)
    return Tree(total or 0, distinct or 0, hashes[order], counts[order].astype(np.int64), []), vocabulary


def train(
    texts: DataFrame, depth: int = 2, p_min: float = 2e-4, gamma_min: float = 2e-3, least_pair: int = 5, kappa: float = 5.0
) -> tuple[Tree, DataFrame]:
    """(text) -> the tree, and the table of all training words: (thing: hash as long, n).

    Every text counts whole.  Null and empty texts count as one END.  At most 1 / p_min
    contexts a depth, all of top words, are stored: a tree in memory.
    """
    texts = texts.select(F.col("text").cast("string").alias("text"))
    tree, vocabulary = _root(texts)
    total = tree.total
    if not total:
        return tree, vocabulary
    end = int(_find(tree.hashes, np.array([END]))[0])
    frequent = np.flatnonzero((tree.counts >= p_min * total) & (np.arange(len(tree.counts)) != end))
    level = Level(frequent, frequent[:, None], tree.counts[frequent])
    for d in range(1, depth + 1):
        if not len(level.contexts):
            break
        tree.levels.append(level)
        known, levels = tree.hashes, list(tree.levels)

        def pairs(part: ts.Slice, known=known, levels=levels) -> np.ndarray:
            h, first = _tokens(part)
            word = _find(known, h)
            for context in _contexts(word, first, levels):
                pass
            ok = (context >= 0) & (word >= 0)
            return context[ok] * TOP + word[ok]

        # gamma_min of the rarest candidate is the least that any context asks for; counts add up to
        # total at most, so no more than 1 / (gamma_min * p_min) of them pass
        floor = max(least_pair, gamma_min * int(level.counts.min()))
        found = _counts(texts, pairs).where(F.col("n") >= floor)
        codes, n = _arrays(found.orderBy("thing"))
        _retain(tree, d - 1, codes.astype(np.int64), n.astype(np.int64), gamma_min, kappa)
        last = codes % TOP
        more = (n >= p_min * total) & (last != end)
        level = Level(
            codes[more].astype(np.int64),
            np.concatenate([level.words[codes[more] // TOP], last[more][:, None]], axis=1),
            n[more].astype(np.int64),
        )
    return tree, vocabulary


def _retain(tree: Tree, d: int, codes: np.ndarray, n: np.ndarray, gamma_min: float, kappa: float) -> None:
    """The divergence test of every candidate of level d, and what is stored after those that pass it."""
    level = tree.levels[d]
    size = len(level.contexts)
    context, word = codes // TOP, codes % TOP
    before = tree.root(tree.counts[word])
    for k in range(d):  # what the suffixes of the context, shortest first, make of the word
        up = tree.levels[k]
        numbers = {tuple(w): i for i, w in enumerate(up.words.tolist())}
        suffix = np.array([numbers.get(tuple(w[-(k + 1) :]), -1) for w in level.words.tolist()], dtype=np.int64)[context]
        before = _step(up, suffix, word, before)
    p = n / level.counts[context]
    strong = (n >= gamma_min * level.counts[context]) & (2 * n * np.log(p / before) >= GAIN)
    codes, n, context, word, before, p = (x[strong] for x in (codes, n, context, word, before, p))
    add = lambda x: np.bincount(context, weights=x, minlength=size)
    inside, expected, entries = np.minimum(add(p), 1.0), np.minimum(add(before), 1.0), add(np.ones(len(p)))
    out, out_expected = np.maximum(1 - inside, 1e-12), np.maximum(1 - expected, 1e-12)
    g = 2 * level.counts * (add(p * np.log(p / before)) + out * np.log(out / out_expected))
    level.kept = (entries > 0) & (g > entries + 4 * np.sqrt(2 * entries) + 10)
    mass = n / (level.counts[context] + kappa)
    level.rest = np.where(level.kept, 1 - add(mass), 1.0)
    stored = level.kept[context]
    level.codes, level.mass = codes[stored], mass[stored]


@dataclass
class Runs:
    """The weights of runs of up to `longest` words, in units of 1 / _GRID: a table (thing, n, units) of all, and what is sent of it."""

    table: DataFrame | None
    longest: int
    hashes: np.ndarray  # of the most frequent, sorted
    units: np.ndarray
    contexts: np.ndarray  # bits of the retained contexts
    pairs: np.ndarray  # bits of the stored pairs, each a context and a word

    def sent(self) -> Runs:
        return Runs(None, self.longest, self.hashes, self.units, self.contexts, self.pairs)

    def weigh(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's weight of frequent runs, the other runs that may have one, and how many those are."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        sums, things, docs = np.zeros(len(first) - 1), [], []
        before = np.zeros(len(h), dtype=bool)  # whether the run without its last word may be a context
        for gram, whole in _grams(h, first, self.longest):
            context = whole & _passes(self.contexts, gram)
            pair = np.flatnonzero(whole & before[: len(gram)])
            some = context.copy()
            some[pair] |= _passes(self.pairs, gram[pair])
            some, before = np.flatnonzero(some), context
            at = _find(self.hashes, gram[some])
            hot = at >= 0
            if hot.any():
                sums += np.bincount(doc[some[hot]], weights=self.units[at[hot]] / _GRID, minlength=len(sums))
            things.append(gram[some[~hot]])
            docs.append(doc[some[~hot]])
        thing, of = np.concatenate(things), np.concatenate(docs)
        return sums, thing[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(sums))


def _join_runs(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The hash of a run of words from those of the run without its last and without its first word."""
    return ts.mix(ts.mix(prefix * np.uint64(0xD1342543DE82EF95) + np.uint64(1)) + suffix)


def _grams(h: np.ndarray, first: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 the hash of the run that starts at every token, and whether it lies in one document."""
    inner = np.ones(len(h), dtype=bool)
    inner[first[1:] - 1] = False
    gram, whole = h, np.ones(len(h), dtype=bool)
    yield gram, whole
    for _ in range(1, longest):
        gram, whole = _join_runs(gram[:-1], gram[1:]), inner[: len(gram) - 1] & whole[1:]
        yield gram, whole


_BITS = (0, 6, 12)  # below the bits that choose the slot, where the numbers of a thing's bits in its slot stand


def _filter(things: DataFrame) -> np.ndarray:
    """Three bits of one slot set for each thing; of fixed size, so others may pass too."""
    slots = things.groupBy(F.expr(f"shiftrightunsigned(thing, {64 - _SLOTS})").alias("slot"))
    bit = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(thing, {58 - _SLOTS - k}) & 63 as int))" for k in _BITS)
    slot, bits = _arrays(slots.agg(F.expr(f"bit_or({bit})").alias("bits")))
    out = np.zeros(1 << _SLOTS, dtype=np.uint64)
    out[slot] = bits.view(np.uint64)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    own = bits[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)]
    out = np.ones(len(h), dtype=bool)
    for k in _BITS:
        out &= (own >> ((h >> np.uint64(58 - _SLOTS - k)) & np.uint64(63))) & np.uint64(1) > 0
    return out


def _most(counted: DataFrame, most: int, *columns: str) -> list[np.ndarray]:
    """Columns of the rows of greatest n: as many as a bound on n leaves at `most`.  No task and no driver sorts them."""
    step = F.floor(F.log2("n") * 16)
    left, bound = most, None
    for r in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        left -= r["count"]
        if left < 0:
            break
        bound = r["step"]
    return _arrays(counted.where(step >= F.lit(bound)).select(*columns) if bound is not None else counted.where("false").select(*columns))


def _runs(part: ts.Slice, length: int, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `length` words whose two shorter runs, the first and the last words, pass their filters, as those two."""
    h, first = _tokens(part)
    for gram, whole in _grams(h, first, length - 1):
        pass
    inner = np.ones(len(h), dtype=bool)
    inner[first[1:] - 1] = False
    at = np.flatnonzero(whole[:-1] & whole[1:] & inner[: max(len(gram) - 1, 0)])
    at = at[_passes(before, gram[at])]
    at = at[_passes(after, gram[at + 1])]
    return gram[at], gram[at + 1]


def _count_runs(batches: Iterator[pa.RecordBatch], length: int, before: np.ndarray, after: np.ndarray, often: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts of the runs of `length` words that pass the filter `often`, if there is one, and whose two shorter runs pass `before` and `after`."""
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        prefix, suffix = (np.concatenate(x) for x in zip(*held))
        _, at, counts = np.unique(_join_runs(prefix, suffix), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(prefix[at].view(np.int64)), pa.array(suffix[at].view(np.int64)), pa.array(counts)], names=["prefix", "suffix", "n"]
        )

    for batch in batches:
        for part in ts.slices(batch.column(0), lower=True):
            prefix, suffix = _runs(part, length, before, after)
            if often is not None:
                some = _passes(often, _join_runs(prefix, suffix))
                prefix, suffix = prefix[some], suffix[some]
            held.append((prefix, suffix))
            n += len(prefix)
            if n >= _FLUSH // 2:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def _name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prefix, suffix = (b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_join_runs(prefix, suffix).view(np.int64))], names=[*b.schema.names, "thing"])


def grow(
    texts: DataFrame, depth: int = 3, support: int = 8, least_pair: int = 5, kappa: float = 5.0
) -> tuple[Tree, DataFrame, Runs]:
    """(text) -> the root, the table of all training words, and the weights of the contexts below the root.

    A context is a candidate if it occurs `support` times, a word after it is stored if the
    two occur `least_pair` times together, whatever the size of the corpus.
    """
    if support < least_pair:
        raise ValueError("support must be least_pair or more")
    texts = texts.select(F.col("text").cast("string").alias("text"))
    tree, vocabulary = _root(texts)
    scratch = Scratch(texts.sparkSession)
    root = (F.col("n") + F.lit(0.5)) / F.lit(tree.total + 0.5 * (tree.distinct + 1))
    end = F.lit(int(END))
    now = vocabulary.where(F.col("n") >= least_pair).select("thing", "n", root.alias("p"), (F.col("thing") == end).alias("ends"))
    contexts = pairs_of = None
    for length in range(2, depth + 2):
        candidates = now.where((F.col("n") >= support) & ~F.col("ends")).select(F.col("thing").alias("prefix"), F.col("n").alias("c"))
        may, after, often = _filter(candidates.select(F.col("prefix").alias("thing"))), _filter(now), None
        if length == 2:  # longer runs are few, as both shorter ones must be frequent
            # the 40 bits of a hash count at least as often as each run that has them: few runs are left to be counted in full
            rough = _counts(texts, lambda part, may=may, after=after: _join_runs(*_runs(part, 2, may, after)) >> np.uint64(24))
            often = _filter(scratch.written(rough.where(F.col("n") >= least_pair).select(F.shiftleft("thing", 24).alias("thing")), "rough"))
        found = texts.mapInArrow(lambda b, length=length, may=may, after=after, often=often: _count_runs(b, length, may, after, often), "prefix long, suffix long, n long")
        found = found.groupBy("prefix", "suffix").agg(F.sum("n").alias("n")).where(F.col("n") >= least_pair)
        before = now.select(F.col("thing").alias("suffix"), F.col("p").alias("before"), "ends")
        pairs = scratch.written(found.join(candidates, "prefix").join(before, "suffix").select("prefix", "suffix", "n", "c", "before", "ends"), "pairs")
        kept = scratch.written(_retained(pairs, kappa), "retained")
        mass, rest = F.when(_tells(), F.col("n") / (F.col("c") + F.lit(kappa))).otherwise(0.0), F.col("rest")
        now = pairs.join(kept.select("prefix", "rest"), "prefix", "left").select(
            "prefix",
            "suffix",
            "n",
            F.when(rest.isNull(), F.col("before")).otherwise(rest * F.col("before") + mass).alias("p"),
            F.when(rest.isNotNull() & _tells(), F.log10(1 + mass / (rest * F.col("before")))).alias("weight"),
            "ends",
        )
        now = scratch.written(now.mapInArrow(_name_runs, "prefix long, suffix long, n long, p double, weight double, ends boolean, thing long"), "runs")
        context = kept.select(F.col("prefix").alias("thing"), F.col("c").alias("n"), F.log10("rest").alias("weight"))
        pair = now.where("weight is not null").select("thing", "n", "weight")
        contexts = context if contexts is None else contexts.unionByName(context)
        pairs_of = pair if pairs_of is None else pairs_of.unionByName(pair)
    weights = contexts.unionByName(pairs_of).groupBy("thing").agg(F.max("n").alias("n"), F.sum(F.round(F.col("weight") * _GRID)).cast("int").alias("units"))
    weights = written(weights, "weights")
    hot, units = _most(weights, HOT, "thing", "units")
    hashes = hot.view(np.uint64)
    order = np.argsort(hashes)
    runs = Runs(weights, depth + 1, hashes[order], units[order].astype(np.int32), _filter(contexts), _filter(pairs_of))
    scratch.release()
    return tree, vocabulary, runs


def _tells() -> Column:
    """Whether a pair comes so much more often than predicted that it is stored."""
    return 2 * F.col("n") * F.log(F.col("n") / F.col("c") / F.col("before")) >= F.lit(GAIN)


def _retained(pairs: DataFrame, kappa: float) -> DataFrame:
    """(prefix, c, rest) of the contexts that pass the divergence test of _retain()."""
    p = F.col("n") / F.col("c")
    each = pairs.where(_tells()).groupBy("prefix").agg(
        F.max("c").alias("c"),
        F.least(F.sum(p), F.lit(1.0)).alias("inside"),
        F.least(F.sum("before"), F.lit(1.0)).alias("expected"),
        F.sum(p * F.log(p / F.col("before"))).alias("told"),
        F.count("*").alias("entries"),
        F.sum("n").alias("stored"),
    )
    out, out_expected = (F.greatest(1 - F.col(x), F.lit(1e-12)) for x in ("inside", "expected"))
    g = 2 * F.col("c") * (F.col("told") + out * F.log(out / out_expected))
    passed = each.where(g > F.col("entries") + 4 * F.sqrt(2 * F.col("entries")) + 10)
    return passed.select("prefix", "c", (1 - F.col("stored") / (F.col("c") + F.lit(kappa))).alias("rest"))


def _step(level: Level, context: np.ndarray, word: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(word | context) from P(word | its suffix); context -1, or one not retained: the same."""
    here = np.flatnonzero((context >= 0) & level.kept[context])
    if not len(here):
        return p
    p = p.copy()
    c, w = context[here], word[here]
    at = np.where(w >= 0, _find(level.codes, c * TOP + w), -1)
    p[here] = level.rest[c] * p[here] + np.where(at >= 0, level.mass[at] if len(level.mass) else 0.0, 0.0)
    return p


def _score(batches: Iterator[pa.RecordBatch], tree: Tree, runs: Runs | None, carried: list[str]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        out: list[list] = [[] for _ in range(9)]
        for part in ts.slices(batch.column(0), lower=True):
            h, first = _tokens(part)
            word = _find(tree.hashes, h)
            known = word >= 0
            # for a word outside the top list only the factor before its root probability
            base = np.where(known, tree.root(tree.counts[word]) if len(tree.counts) else 1.0, 1.0)
            p = base
            for level, context in zip(tree.levels, _contexts(word, first, tree.levels)):
                p = _step(level, context, word, p)
            away = np.flatnonzero(~known)
            if runs is None:
                sums, deep, n_deep = np.zeros(part.n_docs), h[:0], np.zeros(part.n_docs, dtype=np.int64)
            else:
                sums, deep, n_deep = runs.weigh(h, first)
            for column, value in zip(
                out,
                (
                    row + np.arange(part.n_docs),
                    np.diff(first),
                    ts.per_doc(known.astype(np.int64), first),
                    ts.per_doc(np.log10(base), first),
                    ts.per_doc(np.log10(p), first) + sums,
                    h[away].view(np.int64),
                    np.diff(np.searchsorted(away, first)),
                    deep.view(np.int64),
                    n_deep,
                ),
            ):
                column.append(value)
            row += part.n_docs
        if not batch.num_rows:
            continue
        whole = [np.concatenate(c) for c in out]
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(whole[k + 1])]).astype(np.int32)), pa.array(whole[k])) for k in (5, 7)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i + 1) for i in range(len(carried))]
            + [pa.array(c) for c in whole[:5]]
            + lists,
            names=carried + ["_row", "n_tokens", "_known", "_base", "_score", "_away", "_deep"],
        )


def score(docs: DataFrame, tree: Tree, vocabulary: DataFrame, carried: list[str], runs: Runs | None = None) -> DataFrame:
    """(text, carried columns) -> carried, n_tokens, n_known, train_tokens, base_score, score; one row per row.

    Scores are log10 probabilities of the whole text and its END.  A null text scores as an
    empty one.  Equal rows give equal rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("text").cast("string").alias("_text"), *carried)
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.select(*carried).dtypes)
    sent = None if runs is None else runs.sent()
    first = docs.mapInArrow(
        lambda b: _score(b, tree, sent, carried),
        f"{kinds}, _row long, n_tokens long, _known long, _base double, _score double, _away array<long>, _deep array<long>",
    )
    first = written(first, "scores")
    n, v = tree.total, tree.distinct
    away = first.select("_row", F.explode("_away").alias("thing"))
    joined = away.join(vocabulary.withColumnRenamed("n", "_n"), "thing", "left")
    each = F.log10((F.coalesce("_n", F.lit(0)) + F.lit(0.5)) / F.lit(n + 0.5 * (v + 1)))
    sums = written(joined.groupBy("_row").agg(F.sum(each).alias("_more"), F.count("_n").alias("_found")), "awaysums")
    more = F.coalesce("_more", F.lit(0.0))
    joined, below = first.drop("_away", "_deep").join(sums, "_row", "left"), F.lit(0.0)
    if runs is not None:
        deep = first.select("_row", F.explode("_deep").alias("thing")).join(runs.table.select("thing", (F.col("units") / F.lit(_GRID)).alias("weight")), "thing")
        deep = written(deep.groupBy("_row").agg(F.sum("weight").alias("_below")), "deepsums")
        joined = joined.join(deep, "_row", "left")
        below = F.coalesce("_below", F.lit(0.0))
    return joined.select(
        *carried,
        "n_tokens",
        (F.col("_known") + F.coalesce("_found", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_base") + more).alias("base_score"),
        (F.col("_score") + below + more).alias("score"),
    )


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo by; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def score_corpus(docs: DataFrame, held_out: Column, **training) -> DataFrame:
    """Train on the rows not held out, score all: doc_id, held_out and the columns of score().

    With p_min the tree is that of train(), otherwise that of grow().
    """
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    made = (train if "p_min" in training else grow)(docs.where("not held_out"), **training)
    return score(docs, *made[:2], ["doc_id", "held_out"], *made[2:])
