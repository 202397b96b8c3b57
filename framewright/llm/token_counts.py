"""Edit-aware token counts: a segment tree over a document's pre-tokens, updated where edits touch it.

A text is split by the tokenizer's pattern; merges never cross a pre-token, so a text's count is the sum over its pre-tokens.
Leaves of the tree hold runs of pre-tokens (their text, lengths and counts), inner nodes the sums of characters and tokens. An
edit descends to the pre-tokens that it touches. What may change is split and encoded anew: from the last boundary that the
pattern cannot have looked past the edit from (``LOOKAHEAD`` characters of context), to the first boundary behind the
edit that is also one of the old text. From there on a split gives what it gave before. Only the leaves of that region are read
and changed, and the sums above them.

``trees`` makes a table of trees that is kept; ``apply_edits`` takes it and a table of edits, loads the trees of the edited
documents only, and gives the new table. Nothing is encoded twice.

The vocabulary is a rank file (base64 token, rank) read by the driver and broadcast; it does not grow with the data.

Defined results: null and empty texts have 0 tokens; edits are applied in order, each to the text as it then is, with their
places cut to its length; no edits (or null) leave the count; edits of unknown documents do nothing, those of an id apply to
each of its rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A match of the pattern depends on no more characters behind its end than this.
LOOKAHEAD = 2
LEAF, CACHED = 64, 300_000


class Counter:
    """Splits texts and counts the tokens of pre-tokens, which it remembers up to a bound."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encode(piece))
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known.get
        out = [known(p) for p in pieces]
        if None in out:
            out = [self.count(p) if n is None else n for p, n in zip(pieces, out, strict=True)]
        return out


class Document:
    """A text as the segment tree of its pre-tokens. ``parts`` are its pre-tokens' lengths and counts, if they are known."""

    def __init__(self, text: str, counter: Counter, parts: tuple[np.ndarray, np.ndarray] | None = None):
        self.counter, self.encoded = counter, 0
        if parts is None:
            pieces = counter.pattern.findall(text)
            lengths, counts = list(map(len, pieces)), counter.counts(pieces)
        else:
            lengths, counts = (x.tolist() for x in parts)
        self._deal(text, lengths, counts)

    def _deal(self, text: str, lengths: list[int], counts: list[int]) -> None:
        """Deal the pre-tokens into leaves and sum the tree up, without encoding any."""
        self.texts, self.lengths, self.counts, at = [], [], [], 0
        starts = list(range(0, len(lengths), LEAF)) or [0]
        self.size = 1 << (len(starts) - 1).bit_length()
        sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        if lengths:
            sums[self.size : self.size + len(starts), 0] = np.add.reduceat(lengths, starts)
            sums[self.size : self.size + len(starts), 1] = np.add.reduceat(counts, starts)
        for k, n in zip(starts, sums[self.size :, 0].tolist()):
            self.texts.append(text[at : at + n])
            self.lengths.append(lengths[k : k + LEAF])
            self.counts.append(counts[k : k + LEAF])
            at += n
        low = self.size
        while low > 1:
            sums[low // 2 : low] = sums[low : 2 * low : 2] + sums[low + 1 : 2 * low : 2]
            low //= 2
        self.sums = sums

    @property
    def text(self) -> str:
        return "".join(self.texts)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pieces(self) -> int:
        return sum(map(len, self.lengths))

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        flat = lambda x: np.array([n for leaf in x for n in leaf], dtype=np.int32)
        return flat(self.lengths), flat(self.counts)

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character): the leaf that holds character ``at``, or the last one."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[node, 0])
            if at >= start + left and self.sums[node + 1, 0]:
                start, node = start + left, node + 1
        return node - self.size, start

    def _set(self, leaf: int, text: str, lengths: list[int], counts: list[int]) -> None:
        self.texts[leaf], self.lengths[leaf], self.counts[leaf] = text, lengths, counts
        node = leaf + self.size
        self.sums[node] = len(text), sum(counts)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Put ``insert`` in place of the characters from ``start`` to ``stop``."""
        old, leaves = int(self.sums[1, 0]), len(self.texts)
        start = min(max(start, 0), old)
        stop = min(max(stop, start), old)
        grown, moved = start + len(insert), len(insert) - (stop - start)
        # From the last pre-token that ends early enough before the edit.
        first, at = self._find(max(0, start - LOOKAHEAD - 1))
        begin, keep = at, 0
        for n in self.lengths[first]:
            if begin + n + LOOKAHEAD > start:
                break
            begin, keep = begin + n, keep + 1
        # Leaves are read up to one behind the edit, and on, twice as many each time, until a new boundary is an old one.
        last = min(self._find(stop)[0] + 1, leaves - 1)
        while True:
            read = "".join(self.texts[first : last + 1])
            text, ends = read[begin - at : start - at] + insert + read[stop - at :], last == leaves - 1
            leaf, place, edge, found, met = first, keep, begin, [], False
            for m in self.counter.pattern.finditer(text):
                if not ends and m.end() + LOOKAHEAD > len(text):
                    break
                found.append(m[0])
                position = begin + m.end()
                if position < grown:
                    continue
                while edge < position - moved and leaf < leaves:
                    if place == len(self.lengths[leaf]):
                        leaf, place = leaf + 1, 0
                        continue
                    edge += self.lengths[leaf][place]
                    place += 1
                if edge == position - moved and edge >= stop:
                    met = True
                    break
            if met or ends:
                break
            last = min(leaves - 1, 2 * last - first + 1)
        self.encoded += len(found)
        lengths, counts = list(map(len, found)), self.counter.counts(found)
        if not met:
            leaf, place = leaves, 0
        rest = ("", [], [])
        if leaf < leaves:
            rest = self.texts[leaf][sum(self.lengths[leaf][:place]) :], self.lengths[leaf][place:], self.counts[leaf][place:]
        own = self.texts[first][: begin - at] + "".join(found), self.lengths[first][:keep] + lengths, self.counts[first][:keep] + counts
        if leaf == first:
            self._set(first, *(x + y for x, y in zip(own, rest, strict=True)))
        else:
            self._set(first, *own)
            for k in range(first + 1, min(leaf, leaves)):
                self._set(k, "", [], [])
            if leaf < leaves:
                self._set(leaf, *rest)
        if len(self.lengths[first]) > 8 * LEAF:
            self._deal(self.text, *(x.tolist() for x in self.parts()))


EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("insert", T.StringType())]))


def _edited(doc: Document, edits: list[dict] | None) -> int:
    for e in edits or []:
        doc.edit(e["start"] or 0, e["stop"] or 0, e["insert"] or "")
    return len(edits or [])


def _ranks(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def token_counts(docs: DataFrame, edits: Column | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, n_tokens, n_pieces, edited_tokens, n_edits, n_encoded), one for each row of ``docs`` (doc_id, text).

    ``edits`` is an array of (start, stop, insert). ``n_encoded`` counts the pre-tokens that the edits made it encode.
    """
    ranks = _ranks(docs, vocabulary)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (F.lit(None) if edits is None else edits).cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            out = []
            for text, some in zip(batch.column("text"), batch.column("edits"), strict=True):
                doc = Document(text.as_py() or "", counter)
                before = doc.tokens, doc.pieces
                n = _edited(doc, some.as_py())
                out.append((*before, doc.tokens, n, doc.encoded))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_tokens", "n_pieces", "edited_tokens", "n_edits", "n_encoded"])

    names = ("n_tokens", "n_pieces", "edited_tokens", "n_edits", "n_encoded")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in names)]))


def _tree_rows(ranks, kept: bool):
    """Rows (doc_id, text, n_tokens, n_encoded, lengths, counts) from texts, or from such rows with edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            out = []
            for r in batch.select([n for n in batch.schema.names if n != "doc_id"]).to_pylist():
                parts = tuple(np.frombuffer(r[n], dtype="<i4") for n in ("lengths", "counts")) if kept else None
                doc = Document(r["text"] or "", counter, parts)
                if kept:
                    _edited(doc, r["edits"])
                out.append((doc.text, doc.tokens, doc.encoded if kept else doc.pieces, *(x.astype("<i4").tobytes() for x in doc.parts())))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "text", "n_tokens", "n_encoded", "lengths", "counts"])

    return run


def _tree_schema(df: DataFrame) -> T.StructType:
    kinds = {"text": T.StringType(), "n_tokens": T.LongType(), "n_encoded": T.LongType(), "lengths": T.BinaryType(), "counts": T.BinaryType()}
    return T.StructType([df.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds.items())])


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The trees of ``docs`` (doc_id, text), to be written and kept: rows (doc_id, text, n_tokens, n_encoded, lengths, counts).

    ``lengths`` and ``counts`` are the pre-tokens' characters and tokens, four bytes each; sums above them take a pass over
    these. ``n_encoded`` counts the pre-tokens that were encoded to get the row.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_tree_rows(_ranks(docs, vocabulary), False), _tree_schema(rows))


def apply_edits(kept: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``trees`` after edits (doc_id, seq, start, stop, insert), applied by ``seq``. Trees without an edit stay as they are, with
    ``n_encoded`` 0; no other text is read."""
    edits = edits.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "insert"))).alias("edits"))
    edits = edits.select("_id", F.transform("edits", lambda e: F.struct(e["start"].cast("int").alias("start"), e["stop"].cast("int").alias("stop"), e["insert"].alias("insert"))).alias("edits"))
    touched = kept.join(edits, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "lengths", "counts", "edits")
    rest = kept.join(edits, F.col("doc_id") == F.col("_id"), "left_anti").withColumn("n_encoded", F.lit(0).cast("long"))
    return rest.unionByName(touched.mapInArrow(_tree_rows(_ranks(kept, vocabulary), True), _tree_schema(kept)))


def sample_edits(text: Column) -> Column:
    """Three edits that a text itself determines: a word put in, a stretch taken out, a stretch replaced."""
    n = F.greatest(F.char_length(text), F.lit(1))
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), text), n).cast("int")
    edit = lambda k, width, insert: F.struct(place(k).alias("start"), (place(k) + width).alias("stop"), F.lit(insert).alias("insert"))
    return F.array(edit(1, 0, " inserted words"), edit(2, 17, ""), edit(3, 5, "-9 "))
