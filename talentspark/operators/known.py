"""Given token sequences found in the token lists of texts, an Arrow batch at a time.

Spark tokenises the texts, deals them out and adds up what the batches give; inside a batch the positions of all texts
are followed at once, token by token, through a table of the sequences' prefixes. Most positions end at the first token.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from talentspark.operators.joins import fits_broadcast
from talentspark.session import small_batches

# more sequences than that are not sent to the tasks, they are joined
KNOWN_ROWS = 200_000


def listed(table: DataFrame, column: str) -> list[str] | None:
    """The distinct values of a small table's column in string order, None if they are too many to be sent to each task."""
    values = table.select(column).where(F.col(column).isNotNull()).distinct()
    # bounded by the measure before
    return sorted(r[0] for r in values.collect()) if fits_broadcast(values, KNOWN_ROWS) else None


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row and the spelling of each run of two letters a-z or more, found in the bytes of all texts at once."""
    texts = pc.binary_join_element_wise(texts.cast(pa.string()), "", " ", null_handling="replace")
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    letter = whole - np.uint8(ord("a")) < 26
    # each text ends in a blank, so no run reaches over two of them
    border = np.flatnonzero(np.diff(letter, prepend=False))
    start, size = border[::2], border[1::2] - border[::2]
    letter[start[size < 2]] = False
    start, size = start[size > 1], size[size > 1]
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(whole[letter]))
    return np.searchsorted(ends, start, "right"), words


class Tokens:
    """The tokens of a batch's texts one after the other: the row of each, and its number among ``distinct``.

    Made from a column of token lists, or of lower-cased texts, whose words are runs of two letters a-z or more.
    """

    def __init__(self, column: pa.Array):
        words = column.type in (pa.string(), pa.large_string())
        self.rows, tokens = _words(column) if words else (pc.list_parent_indices(column), column.flatten())
        coded = tokens.dictionary_encode()
        self.rows = np.asarray(self.rows).astype(np.int64)
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary.cast(pa.string())

    def numbers(self, words: pa.Array, distinct: pa.Array | None = None) -> np.ndarray:
        """The place in ``words`` of each token, -1 if it is none of them; of its form in ``distinct``, where given."""
        found = pc.index_in(self.distinct if distinct is None else distinct, value_set=words)
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[self.codes]


def _place(known: np.ndarray, codes: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Where each code stands in the sorted ``known``, -1 if nowhere or not valid."""
    if not len(known):
        return np.full(len(codes), -1, np.int64)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(valid & (known[at] == codes), at, -1)


class KnownSequences:
    """Distinct sequences of tokens, each named by its place in the list.

    All tokens but the last are ``inner`` words, the last is one of the ``last`` words; so a caller may tell the two
    apart by their spelling. Level n holds the sequences of n tokens and the beginnings of longer ones.
    """

    def __init__(self, sequences: list[Sequence[str]]):
        self.inner = pa.array(sorted({t for s in sequences for t in s[:-1]}), pa.string())
        self.last = pa.array(sorted({s[-1] for s in sequences}), pa.string())
        inner, last = ({w: i for i, w in enumerate(words.to_pylist())} for words in (self.inner, self.last))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        place = [0] * len(sequences)  # of the beginning so far among those of its length
        left, n = range(len(sequences)), 1
        while left:
            ends = {place[i] * len(last) + last[sequences[i][-1]]: i for i in left if len(sequences[i]) == n}
            left = [i for i in left if len(sequences[i]) > n]
            steps = {i: place[i] * len(inner) + inner[sequences[i][n - 1]] for i in left}
            begun = {code: k for k, code in enumerate(sorted(set(steps.values())))}
            for i, code in steps.items():
                place[i] = begun[code]
            codes = sorted(ends)
            self.levels.append(tuple(np.array(x, np.int64) for x in (codes, [ends[c] for c in codes], list(begun))))
            n += 1

    def find(self, inner: np.ndarray, last: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, positions, names) of the sequences of n tokens that begin at each position, within a row.

        ``inner`` and ``last``: the places of each token among the words of these names, -1 if it is none.
        """
        start, begun = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for n, (ends, names, steps) in enumerate(self.levels, 1):
            at = start + (n - 1)
            inside = np.flatnonzero(at < len(rows))
            inside = inside[rows[at[inside]] == rows[start[inside]]]
            start, begun, at = start[inside], begun[inside], at[inside]
            hit = _place(ends, begun * len(self.last) + last[at], last[at] >= 0)
            found = hit >= 0
            yield n, start[found], names[hit[found]]
            begun = _place(steps, begun * len(self.inner) + inner[at], inner[at] >= 0)
            start, begun = start[begun >= 0], begun[begun >= 0]

    def occurrences(self, tokens: Tokens) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return self.find(tokens.numbers(self.inner), tokens.numbers(self.last), tokens.rows)


def _mapped(tokens: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType) -> DataFrame:
    small_batches(tokens.sparkSession)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                yield run(batch)

    return tokens.mapInArrow(batches, schema)


def _occurrences_and_rows(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the number of rows that hold each and its number of occurrences."""
    which, distinct = pd.factorize(keys)
    size = max(len(distinct), 1)
    held = pd.unique(rows * size + which) % size
    return distinct, np.bincount(held, minlength=len(distinct)), np.bincount(which, minlength=len(distinct))


def partial_counts(tokens: DataFrame, column: str, parts: list[str] | None, by: str | None) -> DataFrame:
    """(by, term, df, cf) with one row per batch and word of the texts or lists in ``column``, which are to be added up by term.

    With ``parts``, n-grams of equal length, it is the grams of one word more whose first and last words are such
    parts, as ``_code``: number of the first part times their number, plus that of the last.
    """
    own = [] if by is None else [StructField(by, tokens.schema[by].dataType)]
    key = StructField("term", StringType()) if parts is None else StructField("_code", LongType())
    schema = StructType([*own, key, StructField("df", LongType()), StructField("cf", LongType())])
    known = None if parts is None else KnownSequences([p.split(" ") for p in parts])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Tokens(batch.column(column))
        rows, keys, size = found.rows, found.codes, max(len(found.distinct), 1)
        if known is not None:
            numbers, size = np.full(len(rows) + 1, -1, np.int64), max(len(parts), 1) ** 2
            for _, at, names in known.occurrences(found):
                numbers[at] = names
            follows = (numbers[:-1] >= 0) & (numbers[1:] >= 0) & (np.r_[rows[1:], -1] == rows)
            at = np.flatnonzero(follows)
            rows, keys = rows[at], numbers[at] * len(parts) + numbers[at + 1]
        groups = None if by is None else batch.column(by).dictionary_encode(null_encoding="encode")
        if groups is not None:
            keys = keys + groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)[rows] * size
        distinct, df, cf = _occurrences_and_rows(keys, rows)
        out = [] if groups is None else [groups.dictionary.take(pa.array(distinct // size))]
        names = pa.array(distinct % size)
        out += [found.distinct.take(names) if known is None else names, pa.array(df), pa.array(cf)]
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    return _mapped(tokens, run, schema)


def partial_hits(tokens: DataFrame, id_col: str, column: str, terms: list[str]) -> DataFrame:
    """(id, _no, _n): how often each text holds each of the ``terms``, by their number; rows of one id are to be added up."""
    schema = StructType([tokens.schema[id_col], StructField("_no", LongType()), StructField("_n", LongType())])
    known = KnownSequences([t.split(" ") for t in terms])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Tokens(batch.column(column))
        keys = [found.rows[at] * len(terms) + names for _, at, names in known.occurrences(found)]
        which, distinct = pd.factorize(np.concatenate([np.zeros(0, np.int64), *keys]))
        size = max(len(terms), 1)
        ids = batch.column(id_col).take(pa.array(distinct // size))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(distinct % size), pa.array(np.bincount(which, minlength=len(distinct)))], names=schema.names)

    return _mapped(tokens, run, schema)


def run_starts(tokens: DataFrame, id_col: str, column: str, grams: list[str]) -> DataFrame:
    """(id, _no, start) of each occurrence of the ``grams``, tokens joined by single blanks, in the lists of ``column``."""
    schema = StructType([tokens.schema[id_col], StructField("_no", LongType()), StructField("start", IntegerType())])
    known = KnownSequences([g.split(" ") for g in grams])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, none = Tokens(batch.column(column)), [np.zeros(0, np.int64)]
        hits = [(at, names) for _, at, names in known.occurrences(found)]
        at, names = (np.concatenate(none + list(x)) for x in (zip(*hits, strict=True) if hits else ((), ())))
        rows = found.rows[at]
        start = (at - np.searchsorted(found.rows, rows)).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows)), pa.array(names), pa.array(start)], names=schema.names)

    return _mapped(tokens, run, schema)


def partial_runs(
    pieces: DataFrame, id_col: str, column: str, runs: list[list[str]], edged: list[bool], blanks: str
) -> DataFrame:
    """(id, _no, _prev, _next) of each text that holds one of the ``runs`` of pieces, once for each pair of neighbours.

    A piece is a token with the blanks after it; the last piece of a run is given without them and found with or
    without. The neighbours are the pieces that touch the run, null where blanks or the text's ends do, and for runs
    that are not ``edged``.
    """
    schema = StructType([
        pieces.schema[id_col], StructField("_no", LongType()), StructField("_prev", StringType()), StructField("_next", StringType()),
    ])
    known, asked = KnownSequences(runs), np.array(edged, bool)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Tokens(batch.column(column))
        bare = pc.utf8_rtrim(found.distinct, characters=blanks)
        tight = pc.equal(bare, found.distinct).to_numpy(zero_copy_only=False).astype(bool)[found.codes]
        # a border on both sides, so that every position has neighbours
        rows, codes = np.r_[-1, found.rows, -1], np.r_[-1, found.codes, -1]
        prev = np.where(np.r_[False, tight, False][:-2] & (rows[:-2] == found.rows), codes[:-2], -1)
        follows = np.where(tight & (rows[2:] == found.rows), codes[2:], -1)
        keys, sides, width = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(found.distinct) + 1
        for n, at, names in known.find(found.numbers(known.inner), found.numbers(known.last, bare), found.rows):
            keys.append(found.rows[at] * len(runs) + names)
            sides.append(np.where(asked[names], (prev[at] + 1) * width + follows[at + n - 1] + 1, 0))
        which, pairs = pd.factorize(np.concatenate(sides))
        both = pd.unique(np.concatenate(keys) * max(len(pairs), 1) + which)
        keys, pairs = both // max(len(pairs), 1), pairs[both % max(len(pairs), 1)]
        near = [found.distinct.take(pa.array(c - 1, mask=c == 0)) for c in (pairs // width, pairs % width)]
        ids = batch.column(id_col).take(pa.array(keys // max(len(runs), 1)))
        return pa.RecordBatch.from_arrays([ids, pa.array(keys % max(len(runs), 1)), *near], names=schema.names)

    return _mapped(pieces, run, schema)
