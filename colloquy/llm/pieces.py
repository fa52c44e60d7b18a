"""Splitting long texts at natural boundaries (problem 10).

Every place between two tokens has a boundary strength. A sparse table over the
strengths answers "strongest place in this window, the rightmost of equals" in
constant time. From the start of a piece the permissible window for its end is
[start + max_tokens * fill, start + max_tokens]; the strongest place there is
the cut, and the next piece starts at the strongest place between ``overlap``
and ``overlap / 2`` tokens before it. The tokens of a piece are counted by
encoding the piece itself: where a cut beside white space makes the piece count
differ from its share of the whole, the window shrinks by the excess.

NULL and empty texts have no piece, texts within the limit are one piece. A
text without any boundary is cut between characters. Repeated rows give
repeated pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.bpe_tree import VOCABULARY, TreeEncoder, encoder, read_vocabulary
from colloquy.session import spread

MAX_TOKENS, OVERLAP, FILL = 1024, 64, 0.5

#: Strengths: inside a character, between characters, between words, after a clause, after a sentence, after a line, after a paragraph.
INSIDE, CHARACTER, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(-1, 6)
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\r\n", np.uint8))


def boundary_strengths(raw: bytes, places: np.ndarray) -> np.ndarray:
    """Strength of cutting ``raw`` before each byte position in ``places`` (0 < place < len)."""
    view = np.frombuffer(raw, np.uint8)
    position = np.arange(len(view))
    blank = _BLANK[view]
    # The last solid byte and the number of line ends in the blank run around each place.
    last_solid = np.maximum.accumulate(np.where(blank, -1, position))
    lines = np.concatenate([[0], np.cumsum(view == 10)])
    before = places - 1
    solid_at = last_solid[before]
    solid = np.where(solid_at >= 0, view[np.maximum(solid_at, 0)], 32)
    breaks = lines[places] - lines[np.maximum(solid_at, 0)]
    touches = blank[before] | blank[places]
    strength = np.where(touches, WORD, CHARACTER)
    strength = np.where(touches & np.isin(solid, np.frombuffer(b",;:)", np.uint8)), CLAUSE, strength)
    ends = np.isin(solid, np.frombuffer(b".?!", np.uint8))
    strength = np.where(touches & ends, SENTENCE, strength)
    # After a line end the cut belongs behind it; before it the cut counts as that of the words.
    strength = np.where(breaks >= 1, LINE, strength)
    strength = np.where(breaks >= 2, PARAGRAPH, strength)
    return np.where(view[places] & 0xC0 == 0x80, INSIDE, strength).astype(np.int16)


class StrongestCut:
    """Sparse table for range-maximum queries whose ties go to the right."""

    def __init__(self, strengths: np.ndarray) -> None:
        # Strength first, position second: the maximum is then the rightmost of the strongest.
        row = strengths.astype(np.int64) * (len(strengths) + 1) + np.arange(len(strengths))
        self.size, self.rows, width = len(strengths) + 1, [row], 1
        while 2 * width <= len(row):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def query(self, low: int, high: int) -> int:
        """Index of the strongest cut in [low, high], both inclusive."""
        level = (high - low + 1).bit_length() - 1
        best = max(self.rows[level][low], self.rows[level][high - (1 << level) + 1])
        return int(best % self.size)


def split_text(own: TreeEncoder, text: str | None, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, fill: float = FILL) -> list[tuple[int, int, int, int]]:
    """Pieces as (first byte, last byte, tokens, tokens shared with the previous piece)."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    ids = own.encode(text)
    if len(ids) <= max_tokens:
        return [(0, len(raw), len(ids), 0)]
    ends = np.cumsum(own.length_of[ids])
    # Cuts are token ends 1 .. n-1, then the end of the text.
    strengths = np.concatenate([[INSIDE], boundary_strengths(raw, ends[:-1]), [PARAGRAPH + 1]])
    place = np.concatenate([[0], ends])
    table, total = StrongestCut(strengths), len(ids)
    pieces: list[tuple[int, int, int, int]] = []
    start, shared = 0, 0
    while True:
        most = min(max_tokens, total - start)
        while True:
            low = start + max(1, int(most * fill)) if start + most < total else total
            cut = table.query(low, start + most)
            while strengths[cut] == INSIDE and cut < start + most:  # only in windows without any character end
                cut += 1
            count = len(own.plain(raw[place[start] : place[cut]])) if strengths[cut] != INSIDE else max_tokens + 1
            if count <= max_tokens or most <= 8:
                break
            most = max(8, most - max(1, count - max_tokens))
        pieces.append((int(place[start]), int(place[cut]), count, shared))
        if cut >= total:
            return pieces
        back = min(overlap, cut - start - 1)
        following, shared = cut, 0
        while back > 0:
            near = table.query(max(start + 1, cut - back), max(start + 1, cut - back // 2 - 1))
            if strengths[near] != INSIDE and near < cut:
                tokens = len(own.plain(raw[place[near] : place[cut]]))
                if tokens <= overlap:
                    following, shared = near, tokens
                    break
            back -= max(1, back // 4)
        start = following


PIECE_COLUMNS = "piece_idx int, n_pieces int, start_char bigint, end_char bigint, n_tokens int, overlap_tokens int, piece string"


def split_documents(documents: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, vocabulary_path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every document, with its place in characters; no shuffle."""
    if not 0 <= overlap < max_tokens // 2:
        raise ValueError("the overlap must be less than half of the limit")
    shared_vocabulary = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    kind = documents.schema[key].dataType.simpleString()
    schema = pa.schema([("piece_idx", pa.int32()), ("n_pieces", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.int32()), ("overlap_tokens", pa.int32()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared_vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, source = [], []
                for i, value in enumerate(part.column(1).to_pylist()):
                    cut = split_text(own, value, max_tokens, overlap)
                    raw = value.encode("utf-8", "replace") if len(cut) > 1 else b""
                    byte = char = 0
                    for k, (low, high, tokens, common) in enumerate(cut):
                        if raw:
                            char += len(raw[byte:low].decode("utf-8")) if low >= byte else -len(raw[low:byte].decode("utf-8"))
                            piece, byte = raw[low:high].decode("utf-8"), low
                        else:
                            piece = value
                        rows.append((k, len(cut), char, char + len(piece), tokens, common, piece))
                        source.append(i)
                columns = [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(source, pa.int64())), *columns], ["key", *schema.names])

    return spread(documents.select(key, text)).mapInArrow(run, f"key {kind}, {PIECE_COLUMNS}").withColumnRenamed("key", key)


def promises_kept(pieces: DataFrame, documents: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, within_limit, overlaps_kept, covered``: aggregates over the pieces of each document against its text.

    A text is covered if each piece is what stands at its place, the first starts
    at 0, each starts at or before the end of the one before, and the last ends with the text.
    """
    own = documents.select(F.col(key), F.col(text).alias("_text"))
    joined = pieces.join(own, key)
    size = F.col("end_char") - F.col("start_char")
    stands = F.substring(F.col("_text"), (F.col("start_char") + 1).cast("int"), size.cast("int")) == F.col("piece")
    steps = joined.select(key, "piece_idx", "n_pieces", "start_char", "end_char", "n_tokens", "overlap_tokens", stands.alias("stands"), F.length("_text").alias("chars"))
    ends = steps.select(key, (F.col("piece_idx") + 1).alias("piece_idx"), F.col("end_char").alias("before"))
    linked = steps.join(ends, [key, "piece_idx"], "left")
    no_gap = F.when(F.col("piece_idx") == 0, F.col("start_char") == 0).otherwise((F.col("start_char") <= F.col("before")) & (F.col("end_char") > F.col("before")))
    return linked.groupBy(key).agg(
        F.bool_and(F.col("n_tokens") <= max_tokens).alias("within_limit"), F.bool_and(F.col("overlap_tokens") <= overlap).alias("overlaps_kept"),
        (F.bool_and("stands") & F.bool_and(no_gap) & (F.max("end_char") == F.max("chars")) & (F.count("*") == F.max("n_pieces"))).alias("covered"),
    )
