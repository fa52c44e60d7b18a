import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe_tree, cuts, endings, fmindex, pairs, pieces, pii, pii_model, pii_training, quantiles, swap_sample, vptree, winnow
from colloquy.llm.words import WordHashes, words

MSG = "array<struct<role:string,content:string>>"
VOCABULARY = [f"w{i}" for i in range(400)]


def random_texts(seed, count, length):
    rng = random.Random(seed)
    return [[rng.choice(VOCABULARY) for _ in range(length)] for _ in range(count)]


def jaccard3(a, b):
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (words(a or ""), words(b or ""))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] and sets[1] else 0.0


@pytest.fixture(scope="module")
def near_rows():
    """Rows with edits of all sizes, copies, reorderings, empty and NULL texts, and a long one."""
    rng = random.Random(5)
    base = random_texts(2, 25, 90)
    out = [" ".join(t) for t in base]
    for t in base:
        for edits in (1, 3, 6, 9):
            changed = list(t)
            for _ in range(edits):
                changed[rng.randrange(len(changed))] = rng.choice(VOCABULARY)
            out.append(" ".join(changed))
        out.append(" ".join(t[45:] + t[:45]))
    out += [out[0], out[0].upper(), out[3] + "!", "", None, " ", "one two", "a b c", "A, b. C", " ".join(random_texts(9, 1, 20_000)[0])]
    return [(i, t) for i, t in enumerate(out)]


def brute_pairs(rows):
    return {(a, b) for a, x in rows for b, y in rows if a < b and jaccard3(x, y) >= 0.6}


@pytest.mark.parametrize("hot", [vptree.HOT, 40])
def test_near_pairs_equal_brute_force_also_in_hot_shards(spark, near_rows, hot):
    df = spark.createDataFrame(near_rows, "rec_id long, text string").repartition(3)
    links = vptree.link_texts(df, "rec_id", "text", hot=hot)
    got = {(r.rec_a, r.rec_b) for r in links.pairs().collect()}
    want = brute_pairs(near_rows)
    assert got <= want and len(got) >= 0.99 * len(want)
    groups = {r.key: (r.group_id, r.n_links) for r in links.groups().collect()}
    degree = Counter(x for p in got for x in p)
    assert all(groups[k][1] == degree[k] for k in groups) and all(groups[a][0] == groups[b][0] for a, b in got)


def test_hot_shard_loses_no_pair(spark):
    """All rows in one shard: the cells around vantage points give what comparing all pairs gives."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, (6, 2)).astype(np.uint64)
    ids = centres[rng.integers(0, 6, 300)] ^ (np.uint64(1) << rng.integers(33, 62, (300, 2)).astype(np.uint64))
    high, low = ids[:, 0].copy(), (ids[:, 1] & ~np.uint64(0xFF000000)) | (np.uint64(7) << np.uint64(24))
    rows = [(1, int(h), int(x)) for h, x in zip(high.view(np.int64), low.view(np.int64))]
    df = spark.createDataFrame(rows, "band long, high long, low long")
    got = {(r.a_high, r.a_low, r.b_high, r.b_low) for r in vptree.near_pairs(df, 35, 25).collect()}
    whole = {(r.a_high, r.a_low, r.b_high, r.b_low) for r in vptree.near_pairs(df, 35, 10_000).collect()}
    want = set()
    for i in range(300):
        for j in range(300):
            if vptree.distance(high[i], low[i], high[j], low[j]) <= 35 and (high[i], low[i]) < (high[j], low[j]):
                want.add((int(high[i : i + 1].view(np.int64)[0]), int(low[i : i + 1].view(np.int64)[0]), int(high[j : j + 1].view(np.int64)[0]), int(low[j : j + 1].view(np.int64)[0])))
    assert got == whole == want


def test_tree_prunes_and_finds_all():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.integers(0, 1 << 63, 500).astype(np.uint64) & ~np.uint64(0xFF000000)
    high[250:], low[250:] = high[:250] ^ np.uint64(5), low[:250]
    tree = vptree.VantageTree(high, low, 8)
    q, m = tree.within(high, low, 6)
    got = set(zip(q.tolist(), m.tolist()))
    want = {(i, j) for i in range(500) for j in range(500) if vptree.distance(high[i], low[i], high[j], low[j]) <= 6}
    assert got == want and tree.compared < 0.5 * 500 * 500
    # At the radius that similarity 0.6 asks for, fingerprints of unrelated texts are not told apart.
    wide = vptree.VantageTree(high, low, 8)
    wide.within(high, low, vptree.RADIUS)
    assert wide.compared > 0.9 * 500 * 500


def test_near_pairs_of_empty_tables(spark):
    links = vptree.link_dialogues(spark.createDataFrame([], f"rec_id long, messages {MSG}"))
    assert links.pairs().count() == 0 and links.groups().count() == 0


@pytest.mark.parametrize("hold", [winnow.HOLD, 8])
def test_overlaps_equal_brute_force(spark, near_rows, hold):
    rows = [(k, t, k % 3 == 0) for k, t in near_rows if t is not None]
    df = spark.createDataFrame(rows, "row long, text string, held boolean").withColumn("key", F.xxhash64("text")).repartition(3)
    found = winnow.overlaps(df, hold=hold)
    a = df.where("held").select(F.col("key").alias("held_key"), F.col("row").alias("x"))
    b = df.where("NOT held").select(F.col("key").alias("train_key"), F.col("row").alias("y"))
    got = {(r.x, r.y) for r in found.join(a, "held_key").join(b, "train_key").collect()}
    side = {k: h for k, _, h in rows}
    want = {(x, y) if side[x] else (y, x) for x, y in brute_pairs([(k, t) for k, t, _ in rows]) if side[x] != side[y]}
    assert got <= want and len(got) >= 0.99 * len(want)
    assert all(r.held_covered <= r.held_words for r in found.collect())


def overlapping(spark, rows, **options):
    """Found and true (held-out, training) rows of ``rows`` (row, text, held)."""
    df = spark.createDataFrame(rows, "row long, text string, held boolean").withColumn("key", F.xxhash64("text")).repartition(3)
    a = df.where("held").select(F.col("key").alias("held_key"), F.col("row").alias("x"))
    b = df.where("NOT held").select(F.col("key").alias("train_key"), F.col("row").alias("y"))
    found = winnow.overlaps(df, **options).join(a, "held_key").join(b, "train_key").collect()
    return {(r.x, r.y) for r in found}, {(x, y) for x, s, h in rows for y, t, g in rows if h and not g and jaccard3(s, t) >= 0.6}, found


def edited_group(count, length=60, every=10):
    """Copies of one text, each with other words at its own places, at most ``every`` apart."""
    rng = random.Random(8)
    base = random_texts(7, 1, length)[0]
    rows = []
    for i in range(count):
        own = list(base)
        for at in range(rng.randrange(every), length, 2 * every):
            own[at] = f"x{i}at{at}"
        rows.append((i, " ".join(own), i % 3 == 0))
    return rows


def test_overlaps_of_a_group_whose_runs_are_all_hot(spark):
    got, want, _ = overlapping(spark, edited_group(120))
    assert want and got == want


def test_overlaps_do_not_depend_on_hold(spark):
    got, want, _ = overlapping(spark, edited_group(90), hold=8)
    assert want and got == want


def test_overlaps_of_short_texts(spark):
    rng = random.Random(11)
    rows = []
    for length in range(3, 25):
        for base in random_texts(length, 3, length):
            rows += [(len(rows) + k, " ".join(x), k == 0) for k, x in enumerate([base, base[:-1] + ["other"], ["more", *base], [*base[:-1], rng.choice(VOCABULARY), base[-1]]])]
    got, want, found = overlapping(spark, rows)
    assert len(want) > 100 and got == want and all(r.held_covered > 0 for r in found)


def test_alignment_covers_moved_blocks():
    a = np.arange(60, dtype=np.uint64)
    assert winnow.align(a, np.concatenate([a[30:], a[:30]])) == (60, 60)
    assert winnow.align(a, a + np.uint64(1000)) == (0, 0)
    assert winnow.align(a[:0], a) == (0, 0)


def test_winnowing_guarantee():
    from colloquy.llm.texts import Batch
    from colloquy.llm.words import WordHashes

    rng = random.Random(4)
    shared = [rng.choice(VOCABULARY) for _ in range(winnow.GRAM + winnow.WINDOW - 1)]
    for _ in range(30):
        texts = [" ".join([rng.choice(VOCABULARY) for _ in range(rng.randrange(30))] + shared + [rng.choice(VOCABULARY) for _ in range(rng.randrange(30))]) for _ in range(2)]
        text, value = winnow.select_minima(Batch(texts, WordHashes()))
        assert set(value[text == 0].tolist()) & set(value[text == 1].tolist())


# Problem 2


def test_bound_and_windows_agree_with_whole_decoding():
    text = "call +1 202 555 0100 or write to a.b@example.com, says Ada Byron of 12 Mill Road. " * 9
    for seed in range(6):
        weights = pii_model.Weights.fresh(6, seed)
        weights.bias[0] = seed
        weights.transitions += np.random.default_rng(seed).normal(0, 1, weights.transitions.shape).astype(np.float32)
        texts = [text, "", " ", text[:70], text[5:90], "Nothing here.", "x"]
        scores = [pii_model.emissions(weights, pii_model.symbols(t)[None], np.array([len(t)]))[:, 0] if t.strip() else None for t in texts]
        want = [[] if s is None else pii_model.spans_of(pii_model.viterbi(weights, s[None], np.array([len(s)]))[0]) for s in scores]
        assert pii_model.find_spans(weights, texts, window=10**6) == want
    covered = [False] * len(text)
    for low, high in pii_model.windows_of(len(text), 100, 20):
        covered[low:high] = [True] * (high - low)
    assert all(covered)


def plain_emissions(weights, codes):
    """One text, one character after the other, in double precision."""
    sigmoid, told = lambda x: 1 / (1 + np.exp(-x)), np.zeros((len(codes), pii_model.TAGS))
    for d, places in enumerate((range(len(codes)), reversed(range(len(codes))))):
        state, cell, hidden = np.zeros(weights.hidden), np.zeros(weights.hidden), weights.hidden
        for t in places:
            let, keep, show, new = np.split(state @ weights.recurrent[d].astype(float) + weights.embed[codes[t]].astype(float) @ weights.project[d] + weights.shift[d], 4)
            cell = sigmoid(keep) * cell + sigmoid(let) * np.tanh(new)
            state = sigmoid(show) * np.tanh(cell)
            told[t] += state @ weights.out[d * hidden : (d + 1) * hidden]
    told += weights.bias
    return told - told[:, :1]


def test_emissions_are_those_of_the_plain_recurrence(monkeypatch):
    monkeypatch.setattr(pii_model, "COLUMNS", 3)  # several groups, the last with a column to spare
    text = "Call +1 202 555 0100 or Ada Byron, 12 Mill Road."
    coded = [pii_model.symbols(t) for t in (text, "x", text[9:30], text[3:], "No.")]
    for weights in (pii_model.Weights.fresh(5, 3), pii_model.Weights.load(pii.WEIGHTS)):
        weights.transitions += np.random.default_rng(2).normal(0, 1, weights.transitions.shape).astype(np.float32)
        got = pii_model.emissions(weights, *pii_model.padded(coded))
        assert got.shape == (len(text), 5, pii_model.TAGS)
        for row, codes in enumerate(coded):
            assert got[: len(codes), row] == pytest.approx(plain_emissions(weights, codes), abs=2e-3)


def test_steps_of_the_runtime_are_those_of_numpy(monkeypatch):
    """numpy's tangents took most of the time where there is no AVX-512, so none is taken where the runtime is installed."""
    pytest.importorskip("onnxruntime")
    rng, room = np.random.default_rng(3), pii_model.Room()
    for weights in (pii_model.Weights.fresh(5, 3), pii_model.Weights.load(pii.WEIGHTS)):
        for lengths in (np.array([1]), np.array([3, 8, 9]), np.array([40, 100, 113, 113])):  # also no whole number of graphs
            streams = rng.integers(1, pii_model.OTHER + 1, (lengths[-1], len(lengths))).astype(np.uint8)
            own = np.arange(lengths[-1])[:, None] < lengths
            streams[~own] = pii_model.PAD
            want = pii_model.gains_by_numpy(weights, streams, lengths, pii_model.Room())[:, :, : len(lengths)]
            got = pii_model.gains_by_graph(weights, streams, lengths, room)
            assert got.transpose(0, 2, 1)[own] == pytest.approx(want.transpose(0, 2, 1)[own], abs=1e-3)
    texts = ["Write to ada.byron@example.com or call Ada Byron at +44 20 7946 0018.", "Fine.", None, "No one is named here. " * 60]
    with monkeypatch.context() as patch:
        patch.setattr(np, "tanh", None)
        found = pii_model.find_spans(weights, texts)
    assert [k for _, _, k in found[0]] == ["email", "name", "phone"] and found[1:] == [[], [], []]
    monkeypatch.setattr(pii_model.pii_graph, "runtime", lambda: None)
    assert pii_model.find_spans(pii_model.Weights.load(pii.WEIGHTS), texts) == found


def test_batches_are_decoded_together_up_to_a_size(monkeypatch):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"text": ["some text"] * n}) for n in (3, 4, 9, 2, 0, 1)]
    monkeypatch.setattr(pii, "TOGETHER", 7)
    assert [[b.num_rows for b in held] for held in pii.gathered(iter(batches))] == [[3, 4], [9], [2, 1]]
    monkeypatch.setattr(pii, "BYTES", 60)
    assert [[b.num_rows for b in held] for held in pii.gathered(iter(batches))] == [[3, 4], [9], [2, 1]]
    monkeypatch.setattr(pii, "BYTES", 30)
    assert [[b.num_rows for b in held] for held in pii.gathered(iter(batches))] == [[3], [4], [9], [2, 1]]


def test_finding_holds_few_bytes_a_character():
    """The states of all steps are more than a cache holds; the model took most of its time to write and read them."""
    import tracemalloc

    weights, texts = pii_model.Weights.load(pii.WEIGHTS), ["Nothing is said here. " * 11 + "Fine. " * (k % 2) for k in range(512)]
    pii_model.find_spans(weights, texts[:9])
    tracemalloc.start()
    try:
        found = pii_model.find_spans(weights, texts)
        assert tracemalloc.get_traced_memory()[1] < 120 * sum(map(len, texts))
    finally:
        tracemalloc.stop()
    assert len(found) == 512


def test_parts_of_a_batch_change_no_item(monkeypatch):
    weights = pii_model.Weights.load(pii.WEIGHTS)
    text = "You can write to ada.byron@example.com or call Ada Byron at +44 20 7946 0018. "
    texts = [text * 30, None, text, "", text[:50] * 20, "\n", "Fine.", text * 2]
    want = [pii_model.find_spans(weights, [t])[0] for t in texts]
    assert len(want[0]) >= 60 and [k for _, _, k in want[2]] == ["email", "name", "phone"] and want[1] == want[3] == want[5] == []
    assert pii_model.find_spans(weights, texts) == want
    monkeypatch.setattr(pii_model, "AT_ONCE", 300)
    assert pii_model.find_spans(weights, texts) == want and pii_model.find_spans(weights, []) == []


def test_viterbi_is_the_best_path():
    import itertools

    weights = pii_model.Weights.fresh(2, 1)
    rng = np.random.default_rng(1)
    weights.transitions += rng.normal(0, 1, weights.transitions.shape).astype(np.float32)
    scores = rng.normal(0, 2, (1, 4, pii_model.TAGS)).astype(np.float32)
    step = weights.transitions + pii_model.BARRED
    value = lambda p: weights.start[p[0]] + pii_model.BARRED[0, p[0]] + scores[0, range(4), p].sum() + sum(step[a, b] for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(pii_model.TAGS), repeat=4), key=value)
    assert pii_model.viterbi(weights, scores, np.array([4]))[0].tolist() == list(best)


def test_gradients_match_differences():
    maker = pii_training.Maker(["Hello there. This is fine.", "Guten Tag, das ist nicht gut."])
    weights = pii_model.Weights.fresh(5, 1)
    data = pii_training.batch_of(maker, 4, 30)
    _, grads = pii_training.gradients(weights, *data)
    for name, index in (("out", (3, 2)), ("bias", (1,)), ("transitions", (0, 0)), ("recurrent", (1, 2, 7)), ("embed", (3, 1)), ("project", (1, 2, 5)), ("shift", (0, 4))):
        own = getattr(weights, name)
        old = own[index]
        own[index] = old + 0.01
        up, _ = pii_training.gradients(weights, *data)
        own[index] = old - 0.01
        down, _ = pii_training.gradients(weights, *data)
        own[index] = old
        assert grads[name][index] == pytest.approx((up - down) / 0.02, rel=0.05, abs=2e-5)


def test_held_out_accuracy_of_the_fitted_model():
    """Messages made of sentences that training never uses, around names, roads and values that were never drawn."""
    background = ["Could you check the reading, please. I think the bill is too high.", "We bought a heater in March. It runs at night.", "Fine, that helps."]
    maker = pii_training.Maker(background, seed=99, frames=pii_training.HELD_OUT)
    weights = pii_model.Weights.load(pii.WEIGHTS)
    texts, truth = zip(*(maker.message() for _ in range(900)))
    hit, wrong, missed = Counter(), Counter(), Counter()
    for tags, spans in zip(truth, pii_model.find_spans(weights, list(texts))):
        want, got = Counter(k for _, _, k in pii_model.spans_of(tags)), Counter(k for _, _, k in spans)
        hit += want & got
        wrong += got - want
        missed += want - got
    assert hit.total() / (hit + wrong).total() > 0.85 and hit.total() / (hit + missed).total() > 0.85
    assert hit["email"] / (hit + missed)["email"] > 0.95


def test_self_training_takes_what_models_agree_on():
    first, second = pii_model.Weights.fresh(4, 1), pii_model.Weights.fresh(4, 1)
    second.bias = second.bias + np.float32(9) * (np.arange(pii_model.TAGS) == 0)
    found, clean = pii_training.agreed([first, first], ["some text here", "more"])
    assert len(found) + len(clean) == 2
    _, clean = pii_training.agreed([second, second], ["some text here", "more"])
    assert clean == ["some text here", "more"]
    maker = pii_training.Maker(["Plain words here."], seed=1)
    maker.found = [("Ask Ann Lee now.", [(4, 11, "name")])]
    for _ in range(20):
        text, tags = maker.found_message()
        (low, high, kind), = pii_model.spans_of(tags)
        assert len(text) == len(tags) and text.startswith("Ask ") and text[high:] == " now." and (low, kind) == (4, "name")


def test_redaction_keeps_the_rest(spark):
    rows = [(1, [("user", "Send it to ada.byron@example.com please. Thanks."), ("assistant", None), ("user", "")]), (2, None), (3, []), (4, [("user", "Nothing here to see.")])]
    df = spark.createDataFrame(rows, f"rec_id long, messages {MSG}").withColumn("spans", F.lit(1))
    out = {r.rec_id: r for r in pii.redacted(df).collect()}
    assert out[1].messages[0].content == "Send it to [EMAIL] please. Thanks." and out[1].messages[1].content is None and out[1].pii_replacements == 1
    assert out[2].messages is None and out[3].messages == [] and out[4].pii_replacements == 0
    assert [tuple(r) for r in pii.items(df).collect()] == [(1, 0, "email", 1)]
    assert pii.items(df.limit(0)).count() == 0


# Problem 3


def plan(spark, rows):
    return spark.createDataFrame(rows, "target_id long, plan_id long, scenario string, turns_min int, turns_max int, target_share double, min_rows int, sample_size int")


def test_samples_meet_shares_and_floors(spark):
    rng = random.Random(2)
    rows = [(i, f"d{i}", rng.choice(["a", "A ", "b", "b-c", None]), rng.choice([1, 3, 7, None])) for i in range(3000)]
    rows += [(5000 + i, f"d{i}", "a", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "rec_id long, id string, scenario string, n_turns int").withColumn("signature", F.lit("x"))
    targets = plan(spark, [(1, 1, "a", 0, 4, 0.5, 1, 400), (2, 1, "b", 0, None, 0.3, 1, 400), (3, 1, "b_c", 6, 9, 0.01, 30, 400), (4, 1, None, 7, None, 0.2, 0, 400), (5, 2, "zzz", 0, None, 0.5, 10, 10), (6, 2, None, None, None, None, None, 10)])
    report = {r.target_id: r for r in swap_sample.target_report(df, targets).collect()}
    drawn = swap_sample.draw_samples(df, targets)
    assert abs(report[1].drawn - 200) <= 1 and abs(report[2].drawn - 120) <= 1 and report[3].drawn >= 30 and report[5].cannot_be_met and not report[6].cannot_be_met
    sizes = {r.plan_id: r["count"] for r in drawn.groupBy("plan_id").count().collect()}
    assert sizes == {1: 400, 2: 10} and drawn.select("plan_id", "id").distinct().count() == 410
    assert max(r.rec_id for r in drawn.collect()) < 5000
    assert {tuple(r) for r in swap_sample.unmet_targets(df, targets).collect()} == {(2, 5)}
    assert {tuple(r) for r in drawn.collect()} == {tuple(r) for r in swap_sample.draw_samples(df.repartition(7), targets).collect()}


def test_targets_that_fail_jointly_are_reported(spark):
    df = spark.createDataFrame([(i, f"d{i}", "ab"[i % 2], 3) for i in range(100)], "rec_id long, id string, scenario string, n_turns int")
    targets = plan(spark, [(1, 1, "a", 0, None, 0.5, 15, 20), (2, 1, "b", 0, None, 0.5, 15, 20), (3, 1, "c", 0, None, 0.1, 0, 20)])
    rows = {r.target_id: r for r in swap_sample.target_report(df, targets).collect()}
    assert rows[3].reason == "scarce" and "competing" in {rows[1].reason, rows[2].reason} <= {None, "competing"} and rows[1].drawn + rows[2].drawn == 20
    assert {tuple(r) for r in swap_sample.unmet_targets(df, targets).collect()} == {(1, 3)}
    counted = swap_sample.drawn_counts(df, targets).first()
    assert (counted.n_rows, counted.n_ids, counted.as_reported) == (20, 20, True)


def test_samples_of_empty_tables(spark):
    df = spark.createDataFrame([], "rec_id long, id string, scenario string, n_turns int")
    targets = plan(spark, [(1, 1, "a", 0, 4, 0.5, 1, 400)])
    assert swap_sample.draw_samples(df, targets).count() == 0 and swap_sample.unmet_targets(df, targets).count() == 1
    assert swap_sample.draw_samples(df, targets.limit(0)).count() == 0 and swap_sample.unmet_targets(df, targets.limit(0)).count() == 0


# Problem 4


def test_pair_rules():
    question = "Could you check the last reading and tell my mother about the tariff before Friday?"
    for answer, want in (
        (None, "empty"), (" \t", "empty"), ("[answer missing]", "empty"), ("&nbsp;", "empty"), ("<p></p>", "empty"), ("—", "empty"), ("​", "empty"), ("N/A", "empty"),
        (question, "copy"), (question.upper(), "copy"), (question + " " + question, "copy"), ("You said: " + question[:-1], "copy"),
        ("I cannot assist with that.", "refusal"), ("I'm sorry, but I can't help with that request. Is there anything else you would like?", "refusal"),
        ("I can't discuss the fee, but I can check the reading on Friday.", None), ("I will not push this offer on you.", None), ("Sorry, that figure I can't confirm; the team will send you a plan.", None),
        ("Ich verstehe, dass Sie verärgert sind; zuerst klären wir die Kaution, danach die Sauna.", "other_language"), ("Yes, Friday works.", None), ("About 11 minutes.", None), ("Sure, I will tell her", None),
    ):
        assert pairs.rule_defect(answer, question) == want, answer
    assert pairs.rule_defect("fine", None) is None and pairs.rule_defect("Le relevé est dans la lettre.", "Pourriez-vous vérifier la remise avant le 14 août ?") is None


def test_shortened_versions_across_partitions(spark):
    texts = [f"{w} sends the letter by post before Friday." for w in VOCABULARY[:60]]
    rows = [(t,) for t in texts] + [(t[:25],) for t in texts[::3]] + [(texts[1][:-1],), (texts[2][:27] + "�",), (None,), ("",)]
    got = {r.text for r in pairs.shortened_versions(spark.createDataFrame(rows, "text string"), "text").collect()}
    assert got == {t[:25] for t in texts[::3]} | {texts[2][:27] + "�"}


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_variants_of_one_cut_are_all_found(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        texts = ["we can send", "we can send ", "we can send...", "we can send -", "we can send the letter on Monday", "we can", "other text here", "we can send the"]
        got = {r.text for r in pairs.shortened_versions(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got >= {"we can send", "we can send ", "we can send the"} and not got & {"we can send the letter on Monday", "other text here", "we can"}


def small_pairs(spark):
    rng = random.Random(1)
    ends = ["by post", "on the phone", "in the app"]
    full = [f"{a} team can send {b} within {c} days, and you may decide {d}." for a in ("Our billing", "Our field", "Our night") for b in ("a plan", "a letter") for c in ("two", "ten") for d in ends]
    rows = [(i, [("user", "Could you tell me about the plan?")], t, rng.choice(full)) for i, t in enumerate(full * 3)]
    rows += [(900, [("user", "Could you tell me about the plan?")], full[0][:-1], full[0][:40]), (901, None, None, "Our field team can send a plan within"), (902, [], "Our night team can send a letter, and", "fine")]
    return spark.createDataFrame(rows, f"pair_id long, context {MSG}, chosen string, rejected string").withColumn("text", F.lit(1))


def test_defective_sides(spark):
    got = {(r.pair_id, r.side): r.defect for r in pairs.defective_sides(small_pairs(spark)).collect()}
    assert got == {(900, "rejected"): "truncated", (901, "chosen"): "empty", (901, "rejected"): "truncated", (902, "chosen"): "truncated"}
    assert pairs.defective_sides(small_pairs(spark).limit(0)).count() == 0
    report = {(r.side, r.defect, r.sign): r.n for r in pairs.defect_report(small_pairs(spark)).collect()}
    assert report["rejected", "truncated", "any"] == 2 and report["chosen", "empty", "rule"] == 1 and report["rejected", "truncated", "shortened"] == 2


def test_refusals_of_many_wordings():
    for text in (
        "I would rather not talk about this.", "This is beyond what I can do here.", "I don't feel at ease discussing prices, so I will stop here.", "My instructions forbid such answers.", "I am not authorised to comment on it. Anything else?", "I must refrain from speculating.",
        "Our policy does not allow me to help with that.", "It would be inappropriate to go into this.", "I choose not to respond.", "I was told not to.",
    ):
        assert pairs.is_refusal(text), text
    for text in ("I cannot say the price yet, but I can call you on Monday.", "No, the fee stays.", "We do not answer the phone on Sundays. Please write to us, and the team will help.", "You can talk to us any time.", "I will not push this on you. The visit takes an hour."):
        assert not pairs.is_refusal(text), text


# Problem 5


@pytest.mark.parametrize("n", [1, 5, 2047, 5000, 40_000])
def test_percentile_error_is_within_its_bound(n):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(3, 1, n), 1)
    sketch, error = {}, 0
    for part in np.array_split(values, max(1, n // 700)):
        own, more = quantiles.sketch_raw(part, 64)
        for level, buffers in own.items():
            sketch.setdefault(level, []).extend(buffers)
        error += more
    sketch, error = quantiles.merge(sketch, error, 64)
    ordered, cumulated = quantiles.weigh(sketch)
    assert cumulated[-1] == n
    for p in (0.01, 0.5, 0.95, 0.99):
        got, rank, full = quantiles.percentile(ordered, cumulated, p), max(1, int(np.ceil(p * n))), np.sort(values)
        low, high = np.searchsorted(full, got, "left") + 1, np.searchsorted(full, got, "right")
        assert low - error <= rank <= high + error
    assert error <= n * 0.2


def requests(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        value = rng.choice([None, float("nan"), -1.0, float("inf"), 5.0]) if i % 9 == 0 else round(rng.expovariate(0.02), 1)
        rows.append((i, "hot" if i % 3 else rng.choice(["x", None, "a|b"]), i % 2, value, 1.0, 2.0, i))
    rows += [(*r[:6], 9999) for r in rows[::5]]
    return spark.createDataFrame(rows, "request_id long, client_key string, concurrency int, ttft_ms double, itl_mean_ms double, total_ms double, logged_at long").withColumn("run_day", F.lit("2026-01-05").cast("date")).withColumn("grp", F.lit(1))


def test_request_percentiles(spark):
    df = requests(spark)
    once = {}
    for r in sorted(df.collect(), key=lambda r: -r.logged_at):
        once[r.request_id] = r
    good = lambda v: v is not None and v == v and 0 <= v < float("inf")
    out = quantiles.request_percentiles(quantiles.request_sketches(df.repartition(5))).collect()
    seen = set()
    for r in out:
        mine = [x for x in once.values() if (x.client_key == r.client_key if r.grouping == "client" else (x.concurrency, str(x.run_day)) == (r.concurrency, str(r.run_day)))]
        values = sorted(v for x in mine if good(v := x[r.metric]))
        assert r.n == len(values)
        for p, got in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            rank = max(1, int(np.ceil(p * len(values))))
            low, high = np.searchsorted(values, got, "left") + 1, np.searchsorted(values, got, "right")
            assert low - r.rank_error <= rank <= high + r.rank_error
        seen.add((r.grouping, r.client_key, r.concurrency, r.metric))
    assert len(seen) == len(out) == 3 * (4 + 2) and ("client", "a|b", None, "total_ms") in seen and ("client", None, None, "total_ms") in seen
    assert quantiles.request_sketches(df.limit(0)).count() == 0


def test_combined_parts_equal_the_whole(spark):
    df = requests(spark).withColumn("logged_at", F.lit(0)).dropDuplicates(["request_id"])
    parts = [quantiles.request_sketches(df.where(F.pmod("request_id", F.lit(3)) == k)) for k in range(3)]
    joined = quantiles.percentiles(quantiles.combine(parts[0].union(parts[1]).union(parts[2])))
    whole = quantiles.percentiles(quantiles.request_sketches(df))
    a, b = ({(r.grp, r.metric): r for r in x.collect()} for x in (joined, whole))
    assert {k: v.n for k, v in a.items()} == {k: v.n for k, v in b.items()}
    assert quantiles.percentiles(quantiles.combine_days(parts[0])).count() == 6


def test_tree_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FAN", 3)
    df = spark.range(60_000).select(F.lit("g").alias("k"), F.pmod(F.col("id") * 7919, F.lit(60_000)).cast("double").alias("v")).repartition(20)
    out = quantiles.percentiles(quantiles.combine_tree(quantiles.build(df, {"g": F.col("k")}, ["v"]), 20)).first()
    assert out.n == 60_000 and out.rank_error < 6000 and abs(out.p50 - 30_000) <= out.rank_error + 1


def test_store_of_parts(spark, tmp_path):
    df = requests(spark).withColumn("logged_at", F.lit(0))
    store = quantiles.SketchStore(spark, str(tmp_path / "store"))
    assert store.parts() == [] and store.combined().count() == 0
    # Every request is in two parts; it counts once.
    store.add("d1", df.where("request_id % 2 = 0 OR request_id % 3 = 0"))
    store.add("d2", df.where("request_id % 2 = 1 OR request_id % 3 = 0"))
    store.add("d2", df.where("request_id % 2 = 1 OR request_id % 3 = 0"))
    assert store.parts() == ["d1", "d2"]
    a, b = ({(r.grp, r.metric): r.n for r in quantiles.percentiles(x).collect()} for x in (store.combined(), quantiles.request_sketches(df)))
    assert a == b
    assert all(r.within for r in quantiles.bounds_kept(df, store.combined()).collect())


# Problem 7


def test_endings():
    for text, want in (
        ("All done.", False), ("Shall we?", False), ("He said \"yes.\"", False), ("More under https://help.example/a1", False), ("Bye 🙂", False), ("(no action needed)", False), ("we can look at the,", True), ("Here is what follows:", True),
        ("Febr�", True), ("Send:\n1. the letter\n2. the plan\n3.", True), ("Order: (1) the letter (2)", True), ("we can look", None), (None, None), ("  ", None), ("...", None),
    ):
        assert endings.sure(text) is want, text
    own = endings.Sentences([["a", ",", "b", "c"], ["d", ";"], [",", "e"]], WordHashes())
    assert own.clause.tolist() == [0, 0, 2, 2, 4, 4, 6, 7]


def test_cut_results_and_limits(spark):
    rng = random.Random(3)
    full = [f"{a} team can send {b} within {c} days, and you may decide {d}." for a in ("Our billing", "Our field", "Our very own night") for b in ("a plan", "a much longer letter") for c in ("two", "ten", "twenty") for d in ("by post", "on the phone", "in the app")]
    rows = [(i, rng.choice(["s1", "s2", None]), t) for i, t in enumerate(full * 4)]
    rows += [(1000 + i, "s3", (t + " " + t)[:50]) for i, t in enumerate(full)] + [(2000, "s1", full[0][:-1]), (2001, "s1", full[0][:31]), (2002, "s2", None), (2003, "s2", ""), (2004, None, full[1][:-10])]
    df = spark.createDataFrame(rows, "result_id long, source string, completion string").withColumn("gen_config", F.struct(F.lit(256).alias("max_tokens"))).withColumn("prompt_messages", F.lit(None).cast(MSG)).withColumn("way", F.lit(0))
    cut = {r.result_id for r in cuts.cut_results(df).where("cut").collect()}
    assert {2001, 2004} <= cut and not cut & set(range(1000)) and not cut & {2000, 2002, 2003}
    assert {1000 + i for i, t in enumerate(full) if len(t) > 50} <= cut
    report = {r.source: r for r in cuts.cut_report(df).collect()}
    assert "characters:50" in report["s3"].limits and report[None].n_cut == 1
    assert cuts.cut_results(df.limit(0)).count() == 0


# Problem 8 and 10


@pytest.fixture(scope="module")
def encoders():
    vocabulary = bpe_tree.read_vocabulary()
    return bpe_tree.TreeEncoder(vocabulary), bpe_tree.TreeEncoder(vocabulary, 8)


def odd_texts():
    rng = random.Random(1)
    alphabet = "ab'sxyz 019 \n\t.,-é漢   　 ́ ½²ll've😀​\x1c"
    return ["", " ", "\n\n", "<|endoftext|> x", "a" * 3000, "漢" * 900, " " * 999, "x'" * 500] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(400)]


def test_tree_encoding_equals_the_tokenizer(encoders):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{bpe_tree.TOKENIZERS}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    for text in odd_texts():
        want = own.encode(text, add_special_tokens=False).ids
        for encoder in encoders:
            assert encoder.encode(text).tolist() == want and encoder.decode(np.array(want)) == text
    assert encoders[0].encode(None).tolist() == []


def test_encode_documents(spark):
    df = spark.createDataFrame([(1, "Hi there"), (2, None), (3, ""), (4, " ")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in bpe_tree.encode_documents(df).collect()}
    assert got == {1: [17250, 612], 2: [], 3: [], 4: [220]}
    assert bpe_tree.encode_documents(df.limit(0)).count() == 0


def test_strongest_cut_is_the_rightmost_maximum():
    rng = np.random.default_rng(2)
    values = rng.integers(-1, 6, 300).astype(np.int16)
    table = pieces.StrongestCut(values)
    for _ in range(500):
        low, high = sorted(rng.integers(0, 300, 2).tolist())
        part = values[low : high + 1]
        assert table.query(low, high) == low + len(part) - 1 - int(np.argmax(part[::-1]))


@pytest.mark.parametrize("limit,overlap", [(1024, 64), (40, 8), (16, 0)])
def test_pieces_keep_their_promises(encoders, limit, overlap):
    own = encoders[0]
    for text in ["First one. Second one, longer.\n\nA paragraph. " * 60, *odd_texts()]:
        cut = pieces.split_text(own, text, limit, overlap)
        raw = text.encode()
        assert (cut == []) == (text == "")
        if cut:
            assert cut[0][0] == 0 and cut[-1][1] == len(raw)
        for low, high, tokens, _ in cut:
            assert len(own.encode(raw[low:high].decode())) == tokens <= limit
        for a, b in zip(cut, cut[1:]):
            assert a[0] < b[0] <= a[1] < b[1] and len(own.encode(raw[b[0] : a[1]].decode())) == b[3] <= overlap


def test_pieces_prefer_natural_ends(encoders):
    text = "One sentence here is fine. Another sentence follows it, as one would expect. " * 30
    raw = text.encode()
    assert all(raw[:high].rstrip().endswith(b".") for _, high, _, _ in pieces.split_text(encoders[0], text, 60, 8))


def test_split_documents(spark):
    df = spark.createDataFrame([(1, "word " * 3000), (2, None), (3, ""), (4, "é short")], "doc_id long, text string").withColumn("piece", F.lit(0))
    rows = pieces.split_documents(df).orderBy("doc_id", "piece_idx").collect()
    assert {r.doc_id for r in rows} == {1, 4} and rows[-1].piece == "é short"
    assert all(("word " * 3000)[r.start_char : r.end_char] == r.piece for r in rows if r.doc_id == 1)
    with pytest.raises(ValueError):
        pieces.split_documents(df, 10, 5)


# Problem 9


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 5, 400)
    index = fmindex.FMIndex(text)
    for length in (1, 2, 3, 5):
        phrases = np.stack([text[i : i + length] for i in range(0, 390, 7)] + [np.full(length, 4)])
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high):
            want = [i for i in range(400 - length + 1) if (phrase > 0).all() and (text[i : i + length] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_leaks_equal_brute_force(spark, monkeypatch):
    items = [(i, " ".join(t)) for i, t in enumerate(random_texts(7, 8, 30))] + [(50, None), (51, "too short"), (52, "")]
    items.append((60, items[0][1]))
    rng = random.Random(6)
    docs = []
    for i in range(60):
        t = [rng.choice(VOCABULARY) for _ in range(40)]
        if i % 3 == 0:
            source, length = rng.choice(items[:8])[1].split(), rng.choice([14, 15, 16, 20, 30])
            start = rng.randrange(31 - length)
            t[10:10] = source[start : start + length]
        docs.append((i, (", " if i % 2 else " ").join(t).title()))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (103, items[1][1] + " X " + items[1][1])]
    grams = lambda t: {tuple(w[k : k + 16]) for w in [words(t or "")] for k in range(len(w) - 15)}
    want = {(d, i) for d, t in docs for i, x in items if grams(t) & grams(x)}
    df, own = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in fmindex.leaked_pairs(df, own).collect()} == want and len(want) > 5
    for r in fmindex.leaked_passages(df, own).collect():
        text = dict(docs)[r.doc_id]
        assert words(text[r.start_char : r.end_char]) == words(text)[r.first_word : r.end_word]
    spans = fmindex.removal_spans(fmindex.leaked_passages(df, own)).where("doc_id = 103").collect()
    assert len(spans) == 2
    monkeypatch.setattr(fmindex, "ITEM_WORDS", 100)
    assert {tuple(r) for r in fmindex.leaked_pairs(df, own).collect()} == want
    assert fmindex.leaked_pairs(df.limit(0), own).count() == 0 and fmindex.leaked_pairs(df, own.limit(0)).count() == 0


def test_overlaps_of_empty_and_one_sided_tables(spark):
    rows = [(1, "train", [("user", "one two three four five six")]), (2, "train", None), (3, None, [("user", "one two three four five six")])]
    df = spark.createDataFrame(rows, f"rec_id long, split string, messages {MSG}").withColumn("scenario", F.lit("s")).withColumn("source", F.lit(None).cast("string")).withColumn("key", F.lit(1)).withColumn("text", F.lit("x"))
    for own in (df, df.limit(0), df.withColumn("split", F.lit("val")), df.where("rec_id = 2")):
        assert winnow.overlap_pairs(own).count() == 0 and winnow.overlap_report(own).count() == 0
    both = df.withColumn("split", F.when(F.col("rec_id") == 3, "test").otherwise(F.col("split")))
    assert [tuple(r) for r in winnow.overlap_pairs(both).collect()] == [(1, 3)]
    assert [tuple(r) for r in winnow.overlap_report(both).collect()] == [("test", "s", None, 1, 1, 1.0)]


def test_hot_seeds_foretold_by_the_sample_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(winnow, "SAMPLE", 1)
    got, want, _ = overlapping(spark, edited_group(90), hold=8)
    assert want and got == want


def test_hot_bands_foretold_by_the_sample_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SAMPLE", 1)
    rows = [(i, t) for i, t, _ in edited_group(70)]
    links = vptree.link_texts(spark.createDataFrame(rows, "rec_id long, text string").repartition(3), "rec_id", "text", hot=10)
    got, want = {(r.rec_a, r.rec_b) for r in links.pairs().collect()}, brute_pairs(rows)
    assert got <= want and len(got) >= 0.99 * len(want) > 100


def test_promises_of_pieces(spark):
    df = spark.createDataFrame([(1, "word " * 3000), (2, ""), (3, None), (4, "short"), (5, "é😀 " * 1200)], "doc_id long, text string")
    out = {r.doc_id: (r.within_limit, r.overlaps_kept, r.covered) for r in pieces.promises_kept(pieces.split_documents(df), df).collect()}
    assert out == {k: (True, True, True) for k in (1, 4, 5)}
