"""Whether a text stops before its last sentence or list is finished.

Shared by problems 4 and 7. What may end a sentence is learned from the texts
themselves, over all rows: for the last words of an open tail (what follows the
last sentence end) it is counted how often the same context went on, ended with
a sentence mark, or ended its text without one. The contexts range from the
openings of sentence and clause with the last two words down to the last word alone.
Also counted is how often a longer word with the same beginning follows the
same word before, which tells a word cut in its middle.

Only counts of contexts that some open tail needs leave the workers; a bitmap of
fixed size skips the rest, and each task adds up before it emits.

A text without any word, NULL or blank, is not judged (``cut`` is NULL). A text
that ends with a sentence mark is complete, unless the mark belongs to the
marker of a list item without text. Ties count as complete.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.texts import KeyBitmap, arrow_rows, batches_of, signed
from colloquy.llm.words import WordHashes, mix
from colloquy.session import durable, spread

#: Marks that end a sentence, what may close after them, and marks after which text must follow.
ENDS, CLOSERS, OPEN_MARKS = ".?!…。？！", "\"'”’»)]}*_", ",;:(-–—/&+=[{<«“�"
TOKEN = re.compile(r"https?://\S+|\d+(?:[.,:]\d+)*|[^\W\d_]+(?:['’\-][^\W\d_]+)*|[^\w\s]", re.UNICODE)
#: The marker of a list item, alone on the last line or after other text.
LONE_MARKER = re.compile(r"(?:^|\s)(?:\(\d{1,3}\)|\d{1,3}[.)]|[-*•])\s*$")
BULLET = re.compile(r"^\s*(?:[-*•]|\(?\d{1,3}[.)])\s+", re.MULTILINE)
SENTENCE_END = re.compile(rf"[{re.escape(ENDS)}]+[{re.escape(CLOSERS)}]*(?=\s|$)")
BLANK_END = re.compile(r"[\s​‌‍﻿]+$")
MIN_COUNT, MIN_CLOSING = 2, 3
FLUSH = 1_000_000


def tokens(sentence: str) -> list[str]:
    """Words and marks, lower case; numbers count as one and the same, links as well."""
    return ["0" if t[0].isdigit() else "@" if t[:4] == "http" else t for t in TOKEN.findall(sentence.lower())]


def sentences(text: str) -> Iterator[tuple[str, bool]]:
    """Sentences with whether each is closed; the last one may be an open tail.

    A sentence ends at a mark followed by white space or the end, and at a line
    end; the line end closes a list item.
    """
    lines = text.split("\n")
    for number, line in enumerate(lines):
        last_line = number == len(lines) - 1
        start = 0
        for match in SENTENCE_END.finditer(line):
            if LONE_MARKER.search(line[start : match.end()]) and not line[start : match.start()].strip().rstrip("0123456789(").strip():
                continue  # "1." opens an item and closes nothing
            yield line[start : match.end()], True
            start = match.end()
        rest = line[start:]
        if rest.strip():
            yield rest, not last_line and bool(BULLET.match(rest))


CONTEXTS, PAIR, ALONE = 7, 5, 6
_CLAUSE_MARKS = np.array(sorted(xxhash.xxh3_64_intdigest(m) for m in (",", ";", ":", "–", "—")), np.uint64)


#: Seeds of the kinds of context, one for sentences and one for list items each; what stands for a word that is not there.
_KINDS = mix(np.arange(1, 2 * CONTEXTS + 2, dtype=np.uint64))
_START, _NONE = np.uint64(xxhash.xxh3_64_intdigest("^")), np.uint64(0)


def _joined(seed: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """Hashes of rows of parts in order."""
    out = seed
    with np.errstate(over="ignore"):
        for part in parts:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out


class Sentences:
    """The words of some sentences in one array, for the hashes of their contexts."""

    def __init__(self, sentences: Sequence[list[str]], hashes: WordHashes) -> None:
        sizes = np.array([len(x) for x in sentences], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.own = np.repeat(np.arange(len(sizes)), sizes)
        self.words = np.concatenate([hashes(x) for x in sentences]) if len(sizes) else np.empty(0, np.uint64)
        # For each word the place of the first word of its clause: a mark that isn't the last word starts one behind it.
        self.clause = self.start[self.own].copy()
        marks = np.flatnonzero(np.isin(self.words[:-1], _CLAUSE_MARKS) & (self.own[1:] == self.own[:-1])) if len(self.words) else np.empty(0, np.int64)
        self.clause[marks + 1] = marks + 1
        self.clause = np.maximum.accumulate(self.clause)
        self.items = np.array([x[0] in "-*•" for x in sentences], bool)

    def at(self, place: np.ndarray, sentence: np.ndarray, missing: np.uint64) -> np.ndarray:
        """The words at ``place``, where these lie in their sentences."""
        inside = (place >= self.start[sentence]) & (place < self.start[sentence + 1])
        return np.where(inside, self.words[np.where(inside, place, 0)], missing)

    def contexts(self, place: np.ndarray) -> np.ndarray:
        """One row per kind of context, the most telling first, of the words at ``place``.

        From the openings of sentence and clause with the last two words down to
        the last word alone. List items have contexts of their own, as they end without a mark.
        """
        own = self.own[place]
        first, clause = self.start[own], self.clause[place]
        word, before, earlier = self.words[place], self.at(place - 1, own, _START), self.at(place - 2, own, _START)
        one, two = self.words[first], self.at(first + 1, own, _NONE)
        head, next_ = self.words[clause], self.at(clause + 1, own, _NONE)
        parts = [(one, two, before, word), (head, next_, before, word), (head, before, word), (earlier, before, word), (one, two, word), (before, word), (word,)]
        kinds = _KINDS[2 * np.arange(CONTEXTS)[:, None] + self.items[own]]
        return np.stack([_joined(kinds[i], *p) for i, p in enumerate(parts)])

    def before(self, place: np.ndarray) -> np.ndarray:
        return self.at(place - 1, self.own[place], _START)


def stem_hashes(before: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """Hashes of the beginning of a word after the word before it."""
    return _joined(_KINDS[2 * CONTEXTS], before, stems)


def open_tail(text: str | None) -> list[str] | None:
    """Tokens of the open tail; None if the text has no word or ends closed."""
    if not text:
        return None
    text = BLANK_END.sub("", text)
    last = None
    for sentence, closed in sentences(text):
        last = (sentence, closed)
    if last is None or last[1]:
        return None
    return tokens(last[0]) or None


def sure(text: str | None) -> bool | None:
    """What the end itself tells: False complete, True cut, None open."""
    if text is None or not re.search(r"\w", text):
        return None
    text = BLANK_END.sub("", text)
    if LONE_MARKER.search(text) and (text[-1] in "-*•" or len(BULLET.findall(text)) + len(re.findall(r"(?:^|\s)\(?\d{1,3}[.)]\s", text)) >= 1):
        return True
    tail = open_tail(text)
    if tail is None:
        return False
    if text[-1] in OPEN_MARKS:
        return True
    if text[-1] in CLOSERS or tail[-1] == "@" or not (text[-1].isalnum() or text[-1] in "'’%°€$£"):
        return False  # a bracket, quotation, link or symbol closes the text
    return None


COUNTS = "context bigint, on bigint, ended bigint, closing bigint"


def tails(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, verdict, keys, stem``: the open tails' contexts; ``verdict`` where the end itself decides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches_of(batches, 4096):
            verdicts, open_, rows = [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                verdict = sure(value)
                tail = open_tail(value) if verdict is None else None
                verdicts.append(verdict)
                if tail:
                    open_.append(tail)
                    rows.append(row)
            own = Sentences(open_, hashes)
            last = own.start[1:] - 1
            keys = signed(np.ascontiguousarray(own.contexts(last).T)) if rows else np.empty((0, CONTEXTS), np.int64)
            stems, lengths = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            rows = np.array(rows, np.int64)
            stems[rows], lengths[rows] = signed(stem_hashes(own.before(last), own.words[last])), np.diff(own.start)
            sizes = np.zeros(batch.num_rows, np.int64)
            sizes[rows] = CONTEXTS
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(verdicts, pa.bool_()), lists, pa.array(stems, pa.int64(), mask=sizes == 0), pa.array(lengths)], ["key", "verdict", "keys", "stem", "tail_words"])

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(key, text)).mapInArrow(run, f"key {kind}, verdict boolean, keys array<bigint>, stem bigint, tail_words int")


class Prefixes:
    """Hashes of all shorter beginnings of words, remembered per worker; the memory is emptied when full."""

    def __init__(self, room: int = 200_000) -> None:
        self.room, self.known = room, {}

    def __call__(self, word: str) -> np.ndarray:
        if word not in self.known:
            if len(self.known) > self.room:
                self.known.clear()
            self.known[word] = np.array([xxhash.xxh3_64_intdigest(word[:end]) for end in range(1, len(word))], np.uint64)
        return self.known[word]


def added_up(keys: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their columns (rows of ``columns``)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edges = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[edges], np.add.reduceat(columns[:, order], edges, axis=1) if len(edges) else columns[:, :0]


def count_contexts(corpus: DataFrame, text: str, wanted: KeyBitmap) -> DataFrame:
    """How often the wanted contexts went on, ended, and closed a text, over the whole corpus.

    For the beginning of a word, "on" is the number of longer words that start with
    it. A sentence that a batch repeats is taken apart once and counts as often as it occurs.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(wanted)

    def counted(values: list[str | None], hashes: WordHashes, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray]:
        found: Counter = Counter()
        for value in values:
            if value:
                found.update(sentences(value))
        taken, times, closed = [], [], []
        for (sentence, is_closed), n in found.items():
            words = tokens(sentence)
            if is_closed:
                while words and words[-1] in ENDS + CLOSERS:
                    words.pop()
            if words:
                taken.append(words)
                times.append(n)
                closed.append(is_closed)
        own = Sentences(taken, hashes)
        if not taken:
            return np.empty(0, np.int64), np.empty((3, 0), np.int64)
        times, closed = np.array(times, np.int64), np.array(closed)
        place = np.arange(len(own.words))
        last = place == own.start[own.own + 1] - 1
        into = np.where(last, np.where(closed[own.own], 1, 2), 0)
        keys = signed(own.contexts(place))
        keep = shared.value.may_have(keys.ravel()).reshape(keys.shape)
        rows = np.nonzero(keep)[1]
        columns = np.zeros((3, len(rows)), np.int64)
        columns[into[rows], np.arange(len(rows))] = times[own.own[rows]]
        # The beginnings of the words that something follows, each with the word before.
        follows = ~last | closed[own.own]
        flat = [w for x in taken for w in x]
        shorter = [prefixes(w) if f else prefixes("") for w, f in zip(flat, follows.tolist())]
        sizes = np.array([len(x) for x in shorter])
        stems = signed(stem_hashes(np.repeat(own.before(place), sizes), np.concatenate(shorter)))
        wanted_stems = shared.value.may_have(stems)
        weights = np.repeat(times[own.own], sizes)[wanted_stems]
        more = np.zeros((3, len(weights)), np.int64)
        more[0] = weights
        return added_up(np.concatenate([keys[keep], stems[wanted_stems]]), np.concatenate([columns, more], axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, prefixes, held, size = WordHashes(), Prefixes(), [], 0

        def flush() -> pa.RecordBatch:
            keys, columns = added_up(*(np.concatenate(x, axis=-1) for x in zip(*held)))
            return arrow_rows({"context": (keys, pa.int64()), **{name: (columns[i], pa.int64()) for i, name in enumerate(("on", "ended", "closing"))}})

        for batch in batches_of(batches, 4096):
            held.append(counted(batch.column(0).to_pylist(), hashes, prefixes))
            size += len(held[-1][0])
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = spread(corpus.select(text)).mapInArrow(run, COUNTS)
    return counts.groupBy("context").agg(F.sum("on").alias("on"), F.sum("ended").alias("ended"), F.sum("closing").alias("closing"))


def judge_endings(texts: DataFrame, corpus: DataFrame, key: str, text: str, corpus_text: str = "text") -> DataFrame:
    """``key, cut, open, share_on``: whether each text is cut; NULL where there is nothing to judge.

    ``texts`` must be part of ``corpus``. ``open`` tells texts whose end itself
    decides nothing. ``share_on`` is the share of the
    deciding context that went on, NULL where the end itself decides.
    """
    own = durable(tails(texts, key, text))
    undecided = own.where("size(keys) > 0")
    wanted = undecided.select(F.explode(F.concat("keys", F.array("stem"))).alias("context"))
    counts = durable(count_contexts(corpus, corpus_text, KeyBitmap(wanted, "context")))
    asked = undecided.select("key", "tail_words", F.posexplode(F.concat("keys", F.array("stem"))).alias("place", "context"))
    answers = asked.join(counts, "context", "left").groupBy("key", "tail_words").agg(
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("on", F.lit(0)).alias("on"), F.coalesce("ended", F.lit(0)).alias("ended"), F.coalesce("closing", F.lit(0)).alias("closing")))).alias("a")
    )
    # At most eight answers a text: the contexts, then the stem.
    at = lambda i, name: F.col("a")[i][name]
    seen = lambda i: at(i, "on") + at(i, "ended")
    # A word that never stood after the one before it, though longer ones with its beginning did, is cut in its middle.
    verdict = F.when((seen(PAIR) == 0) & (at(CONTEXTS, "on") >= MIN_COUNT), F.lit(True))
    share = F.when(F.lit(False), F.lit(0.0))
    for i in range(CONTEXTS):
        if i < PAIR:  # a formula that closes texts and never goes on
            verdict = verdict.when((seen(i) == 0) & (at(i, "closing") >= MIN_CLOSING), F.lit(False))
        verdict = verdict.when(seen(i) >= MIN_COUNT, at(i, "on") / seen(i) > 0.5)
        share = share.when(seen(i) >= MIN_COUNT, at(i, "on") / seen(i))
    # A last word that nobody else uses: cut, as the ends of sentences repeat in the corpus; a lone word is an answer.
    verdict = verdict.otherwise((F.col("tail_words") > 1) & (seen(ALONE) == 0) & (at(ALONE, "closing") < MIN_CLOSING))
    judged = answers.select("key", verdict.alias("by_context"), share.alias("share_on"))
    return own.join(judged, "key", "left").select(
        F.col("key").alias(key), F.coalesce("verdict", "by_context").alias("cut"), (F.size("keys") > 0).alias("open"), "share_on"
    )
