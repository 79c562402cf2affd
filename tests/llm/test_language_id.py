import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from routegraph.llm import language_id as lang

SYLLABLES = {"aa": ("ba", "be", "bi", "bo"), "cc": ("ça", "che", "cru", "ctó"), "дд": ("да", "де", "ды", "дю")}


@pytest.fixture
def corpus(frame, prose):
    rows = [(i * 3 + k, prose(60, i * 3 + k, s), name, "s") for i in range(60) for k, (name, s) in enumerate(SYLLABLES.items())]
    return [*rows, (900, None, "aa", "s"), (901, "", "aa", "s"), (902, "123 ... !!", "cc", "s"), (903, "da" * 9000, None, None), (None, rows[0][1], "cc", None), (5, rows[5][1], "дд", "s")]


def test_held_out_rows_are_told(frame, corpus):
    rows = lang.identify(frame(corpus)).collect()
    assert len(rows) == len(corpus)
    truth = {r[0]: r[2] for r in corpus[:180]}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 20 and all(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    by = {r["doc_id"]: r for r in rows}
    for k in (900, 901, 902):
        assert by[k]["lang_pred"] == "und" and by[k]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_predictions_do_not_see_labels_or_sources(frame, corpus):
    model = lang.fit(lang.training_sample(frame(corpus)))
    plain = {r["doc_id"]: r["verdict"] for r in lang.predict(frame(corpus), model).collect()}
    swapped = frame([(r[0], r[1], "aa", "other") for r in corpus])
    assert plain == {r["doc_id"]: r["verdict"] for r in lang.predict(swapped, model).collect()}


def test_nothing_to_learn_from(frame):
    rows = lang.identify(frame([(1, "some text", None, None), (2, None, None, None)])).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
    assert lang.identify(frame([])).count() == 0


def test_scores_equal_the_kernel_by_definition(frame, corpus):
    sample = lang.training_sample(frame(corpus), per_language=20)
    model = lang.fit(sample, landmarks=4)
    texts = [r[1] for r in corpus[:6]]
    rows = lang.predict(frame(texts), model).collect()
    grams = list(model["column"])
    for r in rows:
        own = set().union(*map(lang.word_grams, lang.letter_words(texts[r["doc_id"]])))
        kernel = np.array([sum(model["marks"][k, m] for k, g in enumerate(grams) if g in own) for m in range(model["marks"].shape[1])]) / np.sqrt(len(own))
        decision = kernel @ model["coefficients"] + model["bias"]
        assert r["verdict"]["lang_pred"] == model["languages"][int(decision.argmax())]
        assert abs(r["verdict"]["score"] - np.clip((decision.max() + 1) / 2, 0, 1)) < 1e-4


def test_accepted_keeps_columns_and_drops_undetermined(frame, corpus):
    docs = frame(corpus).selectExpr("*", "1 as key", "'x' as lang_pred", "0.5 as score")
    kept = lang.accepted(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {900, 901, 902} and set(range(180)) <= ids


def junk(n, seed, letters):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("names", [["aa"], ["aa", "cc"], ["aa", "cc", "дд"]])
def test_accepted_drops_texts_in_no_learned_language(frame, prose, names):
    clean = [(i * 3 + k, prose(60 if i else 2, i * 3 + k, SYLLABLES[name]), name, "s") for i in range(60) for k, name in enumerate(names)]
    foreign = [(1000 + i, junk(40, i, letters), None, "s") for i, letters in enumerate(["αβγδεζηθ", "กขคงจฉชซ", "qwxzjkvpf", "bcdefghijklmnopqrstuvwxyz"])]
    # junk that bears a label, even copied, does not switch the test off
    labelled = [(2000 + i, junk(40, 50 + i % 3, "αβγδεζηθ"), "aa", "s") for i in range(5)]
    told = lang.identify(frame([*clean, *foreign])).where("doc_id >= 1000").collect()
    assert all(r["lang_pred"] != "und" and r["score"] >= 0.25 for r in told)  # the score alone lets all of them through
    assert {r["doc_id"] for r in lang.accepted(frame([*clean, *foreign])).collect()} == {r[0] for r in clean}
    kept = {r["doc_id"] for r in lang.accepted(frame([*clean, *foreign, *labelled])).collect()}
    assert {r[0] for r in clean} <= kept and 1001 not in kept and 1002 not in kept


@pytest.mark.parametrize("copied", ["copied once", "another text", "a third one"])
def test_copies_neither_hide_a_language_nor_reach_the_driver(spark, frame, prose, copied):
    rows = [(i, prose(30, i, SYLLABLES["aa"]), "aa", "s") for i in range(300)] + [(1000 + i, prose(30, i, SYLLABLES["cc"]), "cc", "s") for i in range(40)]
    copies = spark.range(2000, 102_000).selectExpr("id AS doc_id", f"'{copied}' AS text", "'aa' AS lang", "'s' AS source", "null AS n_chars")
    sample = lang.sample_texts(frame(rows).unionByName(copies)).collect()
    assert sum(r["lang"] == "aa" for r in sample) == 250 and sum(r["lang"] == "cc" for r in sample) == 40
    assert len({(r["lang"], r["text"]) for r in sample}) == 290
    hashes = {r["draw"] for r in frame(rows).unionByName(copies).where("lang = 'aa'").selectExpr("xxhash64(text) AS draw").distinct().collect()}
    assert {r["draw"] for r in sample if r["lang"] == "aa"} == set(sorted(hashes)[:250])


def test_very_many_languages_are_all_learned_and_bounded(frame, monkeypatch):
    letters = "abcdefghij"
    rows = [(i, f"{letters[i % 10] * 3}{letters[i // 10 % 15 % 10] * 3}{'xyz'[i % 3]} w{letters[i % 10]}", f"l{i % 150:03}", "s") for i in range(450)]
    rows += [(1000 + i, f"qq{'abcd'[i]}", "common", "s") for i in range(4)]
    sample = lang.sample_texts(frame(rows), per_language=2, most=5).collect()
    assert len({r["lang"] for r in sample}) == 151 and len(sample) == 151  # one of each
    assert max(Counter(r["lang"] for r in lang.sample_texts(frame(rows), per_language=2, most=1000).collect()).values()) == 2
    monkeypatch.setattr(lang, "ALL_LANDMARKS", 40)
    model = lang.fit(lang.training_sample(frame(rows)))
    assert len(model["languages"]) == 151 and model["marks"].shape[1] == 40 and model["coefficients"].shape == (40, 151)


def test_a_language_after_the_hundredth_is_kept(frame, prose):
    shift = lambda text, k: "".join(chr(0x4E00 + 40 * k + ord(c) - 97) if c.isalpha() else c for c in text)
    rows = [(k * 5 + i, shift(prose(60, k * 5 + i), k), f"l{k:03}", "s") for k in range(130) for i in range(5)]
    kept = lang.accepted(frame(rows)).collect()
    assert len(kept) >= 0.98 * len(rows) and len({r["lang"] for r in kept}) == 130


def test_predict_keeps_clashing_columns_and_long_texts(frame, corpus):
    model = lang.fit(lang.training_sample(frame(corpus)))
    docs = frame([*corpus[:6], (7000, "bi bo " * 200_000, "aa", "s")]).selectExpr("*", "1 as grams", "2 as known", "3 as verdict", "4 as batches")
    rows = lang.predict(docs, model).collect()
    assert {r["grams"] for r in rows} == {1} and next(r for r in rows if r["doc_id"] == 7000)["verdict"]["lang_pred"] == "aa"


def test_fit_equals_ridge_regression_solved_by_definition(frame, corpus):
    """Coefficients from the normal equations in kernel space, written out with plain sets."""
    sample = lang.training_sample(frame(corpus), per_language=15)
    model = lang.fit(sample, landmarks=5)
    sets = [set(g.tolist()) for _, g in sample]
    names = sorted({name for name, _ in sample})
    by = {n: [i for i, (x, _) in enumerate(sample) if x == n] for n in names}
    rng = np.random.default_rng(5)
    marks = [int(i) for n in names for i in rng.permutation(by[n])[:5]]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    values, vectors = np.linalg.eigh(np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks]))
    good = values > 1e-6 * values.max()
    z = np.array([[kernel(s, sets[j]) for j in marks] for s in sets]) @ (vectors[:, good] / np.sqrt(values[good]))
    z = np.hstack([z, np.ones((len(z), 1))])
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x, _ in sample])
    w = np.diag([1 / len(by[x]) for x, _ in sample])
    penalty = np.diag([lang.RIDGE] * good.sum() + [1e-9])
    decision = z @ np.linalg.solve(z.T @ w @ z + penalty, z.T @ w @ y)
    grams = list(model["column"])
    for (_, g), want in zip(sample, decision, strict=True):
        own = set(g.tolist())
        k = np.array([sum(model["marks"][i, m] for i, x in enumerate(grams) if x in own) for m in range(len(marks))]) / np.sqrt(len(own))
        assert np.allclose(k @ model["coefficients"] + model["bias"], want, atol=2e-3)
