"""Broken prompt and response pairs (problem 4).

Each side gets at most one defect, in this order:

* empty: NULL, blank, or only a placeholder, markup or marks;
* copy: the words of the last user message, perhaps repeated, introduced or slightly changed;
* refusal: sentences that decline, and nothing else but courtesies;
* other_language: another language than the last user message, by function words;
* truncated: an open end, and a sign that it is not the end: a longer answer that
  starts with the same text (neighbours in the sorted order of all answers), a
  spike of lengths, or endings that go on elsewhere in the corpus.

The answers are sorted by range partitioning of the distinct texts, so copies do
not pile up; of each partition its first and last text and the open beginnings of
the last one reach the driver.
A NULL or empty context has no last user message: copy and other_language do not
apply. Repeated rows are judged each. Languages without any function word of the
lists are not compared.
"""

from __future__ import annotations

import difflib
import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.cuts import hidden_limits, lengths_long, spoken
from colloquy.llm.endings import judge_endings
from colloquy.llm.texts import batches_of
from colloquy.llm.words import words
from colloquy.session import durable, spread

#: Placeholders by their words.
PLACEHOLDERS = {
    "answer missing", "blank", "empty", "empty response", "error", "missing", "n a", "na", "nan", "nbsp", "nil", "no answer", "no content", "no reply", "no response",
    "no text", "none", "not available", "null", "placeholder", "response", "response missing", "tba", "tbc", "tbd", "todo", "undefined", "unavailable",
}
#: Frequent function words of languages.
FUNCTION_WORDS = {
    "en": "a about after again all am an and any are as at be because been before but by can could did do does for from get had has have how i if in into is it its just let may me more most my no not now of on only or our out please right shall she so some than that the their them then there these they this to up us was we were what when where which while who why will with would you your".split(),
    "de": "aber als am an auch auf aus bei bin bis bitte da danach das dass dem den der des die dies doch ein eine einem einen einer er es für haben hat hatten ich ihnen ihr ihre im in ist kann können könnten mein mit möchte nach nicht noch nur oder seit sei sie sich sind über um und uns unser vom von vor was weil wenn werden wie wir wird zu zuerst zum zur".split(),
    "fr": "ai après au aux avant avec avez avons ce ces cette d'abord dans de depuis des du elle en est et il ils je la le les leur lui ma mais mes mon ne nos notre nous on ou où par pas plus pour pourriez que qui reste sa sans se ses si son sont suis sur un une vos votre vous".split(),
    "es": "al ante antes aunque como con cuando de del desde donde el ella en entre era es esta este esto está esté fue ha hasta hay la las le les lo los luego mi muy más ni no nos nuestra nuestro o para pero podría por porque primero que qué se ser si sin sobre son su sus también tiene un una unos usted y ya".split(),
    "it": "al alla anche che chi ci come con da dal dalla dei del della di dove e ed gli ha ho i il in io la le lei lo loro ma mi mio nel nella noi non o per perché più quando questa questo se si sia sono su sua suo un una vi voi".split(),
    "nl": "aan als bij dan dat de deze die dit door een en er haar had heb hebben heeft het hij hoe ik in is je kan maar me met mijn naar niet nog nu of om ons ook op over te tot u uit uw van voor waar was wat we wij zal ze zich zijn".split(),
    "pt": "a ao aos as até com como da das de depois dele do dos e ela ele em entre era essa esse esta este eu foi há isso já lhe mais mas me meu minha muito na nas no nos não nós o os ou para pela pelo por quando que quem se sem ser seu sua são também te tem um uma você".split(),
}
_LANGUAGE_OF: dict[str, list[str]] = {}
for _code, _words in FUNCTION_WORDS.items():
    for _word in _words:
        _LANGUAGE_OF.setdefault(_word, []).append(_code)

#: Verbs of answering and helping, as infinitives and as they stand after "of" or "comfortable".
ANSWERING = "address advise answer assist chat comment comply continue discuss elaborate engage fulfil fulfill handle help opine participate proceed process provide reply respond speak speculate talk".split()
_TO_ANSWER = "|".join(ANSWERING)
_ANSWERING = "|".join((v[:-1] if v.endswith("e") else v + "t" if v == "chat" else v) + "ing" for v in ANSWERING)
#: Phrases that decline: a negated ability, permission or wish with such a verb; rules that forbid; what lies outside of one's task; plain refusals.
REFUSAL = re.compile(
    r"\b(?:can ?not|can['’]t|could not|couldn['’]t|won['’]t|will not|wouldn['’]t|would not|not able to|unable to|not permitted to|not allowed to|not authori[sz]ed to|not supposed to|not meant to|not at liberty to|not free to|not in a position to|not going to|not willing to|unwilling to"
    r"|(?:would|['’]d) (?:rather|prefer) not|prefer not to|choose not to|chose not to|(?:must|have to|need to|will) (?:refrain|abstain)|hesitate to)"
    rf"(?: (?!(?:a|an|any|my|our|that|the|this|your)\b)\w+){{0,3}}? (?:{_TO_ANSWER}|{_ANSWERING})\b"
    rf"|(?:\bnot|n['’]t|\bun)(?: |(?=comfortable))(?:feel )?(?:comfortable|at ease|happy|right)(?: (?:with|about|in|to))? (?:{_TO_ANSWER}|{_ANSWERING})\b"
    rf"|\b(?:not (?:feel )?(?:comfortable|at ease|happy|right)|uncomfortable|uneasy|refrain from|abstain from|keep from|prevents? me from|prohibits? me from|forbids? me from|stops? me from|keeps? me from)(?: (?:with|about|in|to))? (?:{_TO_ANSWER}|{_ANSWERING})\b"
    r"|\b(?:guidelines?|polic(?:y|ies)|rules?|instructions?|programming|safety settings?|terms) (?:\w+ )?(?:do(?:es)? not|don['’]t|doesn['’]t|will not|won['’]t|cannot|can['’]t) (?:allow|permit|let)\b|\b(?:guidelines?|polic(?:y|ies)|rules?|instructions?|programming) (?:forbid|prohibit|prevent|rule)s?\b"
    r"|\b(?:falls?|lies?|goes|is|sits?|well|far) (?:outside|beyond)(?: of)? (?:what (?:i|we)\b|my\b|our\b)|\b(?:outside|beyond) (?:of )?(?:my|our) (?:scope|remit|role|task|abilities|capabilities)\b|\boff[- ]limits (?:for|to) me\b"
    r"|\b(?:must|have to|need to|will|would) (?:\w+ )?(?:decline|refuse)\b|\bi (?:respectfully |politely )?(?:decline|refuse) to\b|\bno comment\b|\bnot something (?:i|we) (?:can|may|will)\b|\b(?:instructed|told|trained|programmed|asked) not to\b"
    r"|\bas an ai\b|\blanguage model\b|\bagainst (?:my|our) (?:policy|policies|guidelines|rules|programming|principles)\b|\bwould (?:be|not be) (?:in)?appropriate (?:for me )?to\b"
    r"|\bkann (?:ich )?(?:ihnen )?(?:leider )?(?:dazu |dabei |damit |das )*(?:keine|nicht)\b|\bdarf ich (?:dazu |das )?nicht\b|\bmöchte ich (?:dazu )?nichts?\b|\bne (?:peux|pouvons|puis) pas\b|\bje (?:refuse|préfère ne pas)\b|\bno (?:puedo|podemos) (?:\w+ )?(?:ayudar|responder|hablar|comentar|contestar)|\bprefiero no\b",
    re.IGNORECASE,
)
#: One of these is in every text that the pattern matches (lower case); a text without any is not searched.
REFUSAL_SIGNS = (
    "not", "n't", "n’t", "unable", "unwilling", "refrain", "abstain", "hesitate", "uncomfortable", "uneasy", "keep from", "me from", "forbid", "prohibit", "prevent", "rule", "outside", "beyond", "limits", "declin", "refus", "no comment", "as an ai", "language model",
    "against", "appropriate", "kann", "darf ich", "möchte ich", " pas", "puedo", "podemos", "prefiero",
)
#: What goes on to help within the same sentence, or as a sentence of its own.
HELP = re.compile(
    r"(?:\b(?:but|so|though|however|instead|meanwhile|yet|still)\b|;)[^.?!]*?\b(?:let (?:me|us)|(?:i|we|you|team|colleague|desk|office)\b[^.?!]*?\b(?:can(?! ?not|['’]t)|could(?! ?not|n['’]t)|will(?! not| leave (?:it|this|that)| stop| end| pass| close| say no more| rest)|shall|get|would be glad|am happy|are happy))\b"
    r"|\b(?:aber|stattdessen|mais|pero|sino)\b[^.?!]*?\b(?:ich|wir|je|nous|puedo|podemos)\b",
    re.IGNORECASE,
)
#: Courtesies that help with nothing.
COURTESY = re.compile(
    r"^\W*(?:is there anything (?:else|more)|anything else|please (?:consult|contact|ask|speak to|reach out to|see) |thank(?:s| you)|i(?:'m| am)? (?:so |very )?sorry|sorry|my apologies|apologies|i apologi[sz]e|i hope (?:you|that)|have a (?:nice|good|great)"
    r"|unfortunately\W*$|let me know if|feel free|good ?bye|take care|i understand\W*$|es tut mir leid|désolé|lo siento)",
    re.IGNORECASE,
)
#: Introductions before a repeated question.
INTRODUCTION = re.compile(r"^\W*(?:customer|user|you (?:said|asked|wrote)|question|prompt|your (?:question|message)(?: was)?|q|human)\s*[:,\-]\s*", re.IGNORECASE)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    plain = re.sub(r"<[^<>]*>", " ", html.unescape(answer)) if "<" in answer or "&" in answer else answer
    found = words(plain)
    return not found or len(found) < 4 and " ".join(found) in PLACEHOLDERS


def is_copy(answer: str, question: str | None, least: float = 0.8) -> bool:
    """Whether the answer aligns with the question, repeated as often as its length asks for."""
    own, asked = words(INTRODUCTION.sub("", answer)), words(question)
    if not own or len(asked) < 2 or len(own) < 0.6 * len(asked):
        return False
    if len(set(own) & set(asked)) < 0.6 * len(set(own) | set(asked)):  # cheap, and implied by the alignment but for repeated changes
        return False
    times = max(1, round(len(own) / len(asked)))
    matcher = difflib.SequenceMatcher(None, own, asked * times, autojunk=False)
    common = sum(b.size for b in matcher.get_matching_blocks())
    return common >= least * max(len(own), len(asked) * times)


def is_refusal(answer: str) -> bool:
    lowered = answer.lower()
    if not any(sign in lowered for sign in REFUSAL_SIGNS):
        return False
    declined = False
    for sentence in re.split(r"(?<=[.?!])\s+", answer.strip()):
        if not words(sentence):
            continue
        if REFUSAL.search(sentence):
            if HELP.search(sentence):
                return False
            declined = True
        elif not COURTESY.search(sentence):
            return False
    return declined


def language(text: str | None) -> str | None:
    """The language with most function words, if it leads clearly."""
    found = words(text)
    score: dict[str, float] = {}
    for word in found:
        if word in _LANGUAGE_OF:
            for code in _LANGUAGE_OF[word]:
                score[code] = score.get(code, 0) + 1
    ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    if not ranked or (len(ranked) > 1 and ranked[1][1] >= 0.85 * ranked[0][1]):
        return None
    return ranked[0][0] if ranked[0][1] >= 2 or len(found) <= 6 else None


def rule_defect(answer: str | None, question: str | None, asked: Callable[[str | None], str | None] = language) -> str | None:
    """The defect by the rules; ``asked`` gives the question's language."""
    if is_empty(answer):
        return "empty"
    if is_copy(answer, question):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    own, wanted = language(answer), asked(question)
    if own and wanted and own != wanted:
        return "other_language"
    return None


def pair_sides(pairs: DataFrame) -> DataFrame:
    """``pair_id, side, answer, question``: one row per side."""
    users = F.filter("context", lambda m: m["role"] == "user")
    question = F.when(F.size(users) > 0, F.element_at(users, -1)["content"])
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("answer")) for s in ("chosen", "rejected"))))
    return pairs.select("pair_id", question.alias("question"), sides.alias("s")).select("pair_id", "s.side", "s.answer", "question")


def apply_rules(sides: DataFrame) -> DataFrame:
    """Adds ``defect`` by the rules."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = lru_cache(4096)(language)  # both sides of a pair, and its copies, have one question
        for batch in batches_of(batches, 2048):
            defects = [rule_defect(a, q, asked) for a, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(defects, pa.string())], ["pair_id", "side", "answer", "defect"])

    return spread(sides.select("pair_id", "side", "answer", "question")).mapInArrow(run, "pair_id bigint, side string, answer string, defect string")


_LOOSE_END = re.compile(r"[\s.…�\-]+$")


def is_shortened(text: str, neighbour: str | None, least: int = 8) -> bool:
    """Whether the neighbour starts with the text, its loose end aside, and goes on with more than marks."""
    stem = _LOOSE_END.sub("", text)
    return neighbour is not None and len(stem) >= least and neighbour.startswith(stem) and len(words(neighbour[len(stem) :])) > 0


def shortened_versions(texts: DataFrame, text: str) -> DataFrame:
    """The distinct texts of which a longer version exists, from neighbours in sorted order.

    While a partition is read, the texts that the current one starts with (their loose ends
    aside) are kept, so that variants of one cut don't hide the longer version; of
    each partition its first text and the kept ones reach the driver, all of them beginnings of its last text.
    """
    distinct = texts.select(F.col(text).alias("text")).where(F.length("text") > 0).distinct()
    ordered = distinct.repartitionByRange("text").sortWithinPartitions("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, first, found = TaskContext.get().partitionId(), None, None, []
        kept: list[tuple[str, str]] = []  # texts without a longer version yet, with their stems
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if first is None:
                    first = value
                while kept and not value.startswith(kept[-1][1]):
                    kept.pop()
                longer = [is_shortened(one, value) for one, _ in kept]
                found += [one for (one, _), yes in zip(kept, longer) if yes]
                kept = [k for k, yes in zip(kept, longer) if not yes]
                if is_shortened(value, before):
                    found.append(value)
                else:
                    kept.append((value, _LOOSE_END.sub("", value)))
                before = value
        rows = [(None, "found", x) for x in found]
        if first is not None:
            rows += [(part, "first", first), *((part, "kept", one) for one, _ in kept), (part, "last", before)]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string()))], ["part", "kind", "text"])

    marked = durable(ordered.mapInArrow(run, "part int, kind string, text string"))
    seams: dict[int, dict[str, list[str]]] = {}
    for r in marked.where("part IS NOT NULL").toLocalIterator():
        seams.setdefault(r.part, {}).setdefault(r.kind, []).append(r.text)
    across: set[str] = set()
    waiting: list[str] = []  # kept texts of earlier partitions
    last = None
    for part in sorted(seams):
        head = seams[part]["first"][0]
        across |= {one for one in waiting if is_shortened(one, head)}
        if is_shortened(head, last):
            across.add(head)
        waiting = [one for one in waiting if head.startswith(_LOOSE_END.sub("", one)) and one not in across] + seams[part].get("kept", [])
        last = seams[part]["last"][0]
    missed = texts.sparkSession.createDataFrame([(one,) for one in sorted(across)], "text string")
    return marked.where("kind = 'found'").select("text").unionByName(missed).distinct()


def pair_corpus(pairs: DataFrame) -> DataFrame:
    answers = pairs.select(F.explode(F.array("chosen", "rejected")).alias("text"))
    return answers.unionByName(pairs.select(F.explode(spoken("context")).alias("text")))


def cut_sides(ruled: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key, shortened, at_limit, unfinished`` of the open-ended sides that a sign shows to be truncated.

    First the neighbours in sorted order, then the spikes of lengths, then what the
    endings of the corpus tell; each sign holds by itself, given an open end.
    """
    open_sides = ruled.where("defect IS NULL").select(F.concat_ws("|", F.col("pair_id").cast("string"), "side").alias("key"), "answer", F.xxhash64("answer").alias("text_hash"))
    longer = shortened_versions(ruled.where("defect IS NULL"), "answer").select(F.xxhash64("text").alias("text_hash"), F.lit(True).alias("shortened"))
    long = lengths_long(open_sides.withColumn("source", F.lit("answers")), "answer").drop("answer")
    at = long.join(hidden_limits(long, ["source"]).drop("n_at"), ["source", "way", "length"]).select("key").distinct().withColumn("at_limit", F.lit(True))
    judged = judge_endings(open_sides, pair_corpus(pairs), "key", "answer")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    signs = open_sides.select("key", "text_hash").join(longer, "text_hash", "left").join(at, "key", "left").join(judged, "key")
    marked = signs.select("key", no("shortened"), no("at_limit"), F.coalesce("cut", F.lit(False)).alias("unfinished"), "open")
    return marked.where("unfinished OR (open AND (shortened OR at_limit))").drop("open")


def defective_sides(pairs: DataFrame) -> DataFrame:
    """``pair_id, side, defect`` of each defective side."""
    ruled = durable(apply_rules(pair_sides(pairs)))
    part = F.split("key", r"\|")
    cut = cut_sides(ruled, pairs).select(part[0].cast("bigint").alias("pair_id"), part[1].alias("side"), F.lit("truncated").alias("defect"))
    return ruled.where("defect IS NOT NULL").select("pair_id", "side", "defect").unionByName(cut)


def defect_report(pairs: DataFrame) -> DataFrame:
    """``side, defect, sign, n``: sides per defect; of truncated ones how many each sign, and each alone, brings."""
    ruled = durable(apply_rules(pair_sides(pairs)))
    cut = durable(cut_sides(ruled, pairs))
    side = F.element_at(F.split("key", r"\|"), 2).alias("side")
    names = ("shortened", "at_limit", "unfinished")
    count = sum((F.col(n).cast("int") for n in names), F.lit(0))
    signs = F.explode(F.concat(F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)), lambda x: x.isNotNull()), F.filter(F.array(*(F.when(F.col(n) & (count == 1), F.lit(f"{n} alone")) for n in names)), lambda x: x.isNotNull()), F.array(F.lit("any"))))
    told = cut.select(side, F.lit("truncated").alias("defect"), signs.alias("sign"))
    return ruled.where("defect IS NOT NULL").select("side", "defect", F.lit("rule").alias("sign")).unionByName(told).groupBy("side", "defect", "sign").agg(F.count("*").alias("n"))
