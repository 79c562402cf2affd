import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from routegraph.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if twice[x] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=4))
def test_repeated_windows_match_brute_force(docs):
    assert q._repeat_words(docs).tolist() == [brute(" ".join(d))[4] for d in docs]


def test_statistics_of_odd_texts(spark, frame, prose):
    texts = [None, "", " \n\t ", "one", "a b c d e f g h a b c d e f g h", "x\nx\n\nx\n y", "é ü # <|> ***\r\nz", prose(3000, 1) + "\n" + prose(40, 2) + "\n" + prose(40, 2), "dup dup", "dup dup"]
    rows = {r["doc_id"]: r for r in q.rule_statistics(frame(texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), t


def test_judge_separates_labelled_rows(spark, frame, prose):
    good = [prose(150, i) for i in range(120)]
    bad = [" ".join(w + "###" for w in prose(150, 1000 + i).split()) for i in range(12)]
    docs = frame([*good, *bad, None, "short"])
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)] + [(120 + i, 0) for i in range(6)] + [(None, 0), (5, None)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in q.judge(docs, labels).collect()}
    assert sum(rows[i]["kept"] for i in range(120)) >= 118
    assert sum(rows[120 + i]["kept"] for i in range(12)) <= 6
    assert min(rows[120 + i]["anomaly_writing"] for i in range(12)) > np.median([rows[i]["anomaly_writing"] for i in range(120)])
    assert rows[132]["base_failed"] and not rows[132]["kept"] and rows[133]["base_failed"]
    again = {r["doc_id"]: r["kept"] for r in q.judge(docs.repartition(3), labels).collect()}
    assert again == {k: r["kept"] for k, r in rows.items()}


def test_without_labels_only_base_rules_decide(spark, frame, prose):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = q.judge(frame([prose(40, 1), "a", (None, prose(30, 2), None, None)]), none).collect()
    assert sorted((r["base_failed"], r["kept"]) for r in rows) == [(False, True), (False, True), (True, False)]
    assert q.judge(frame([]), none).count() == 0


def test_paths_are_shorter_for_outliers():
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(0.5, 0.01, (300, 3)), [[0.9, 0.1, 0.9]]])
    trees = [q.grow_tree(points[rng.choice(301, 128)], rng) for _ in range(60)]
    score = q.anomaly(points, {"trees": trees, "normal": q._average_path(128)})
    assert score[-1] > np.quantile(score[:-1], 0.95)


def test_extra_columns_do_not_matter(spark, frame, prose):
    docs = frame([prose(30, i) for i in range(3)]).selectExpr("*", "1 as n_words", "2 as kept", "3 as anomaly", "4 as n_lines", "5 as _scores")
    assert q.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 3


def lined(prose, seed, menus):
    """Distinct sentences, with the same short line after each if ``menus``."""
    return "\n".join(prose(9, seed * 100 + i) + ("\nRead more" if menus else "") for i in range(14))


def test_repeated_lines_and_odd_writing_are_both_found(spark, frame, prose):
    good = [lined(prose, i, False) for i in range(150)]
    menus = [lined(prose, 300 + i, True) for i in range(10)]
    marked = [" ".join(w + "###" for w in prose(120, 900 + i).split()) for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 150, 2)] + [(150 + i, 0) for i in range(5)] + [(160 + i, 0) for i in range(5)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in q.judge(frame([*good, *menus, *marked]), labels).collect()}
    assert not any(rows[i]["base_failed"] for i in range(170))
    assert sum(rows[i]["kept"] for i in range(150)) >= 145
    assert sum(rows[150 + i]["kept"] for i in range(10)) <= 2 and sum(rows[160 + i]["kept"] for i in range(10)) <= 2


def test_verdicts_equal_forests_walked_by_hand(spark, frame, prose):
    texts = [lined(prose, i, i % 9 == 0) + (" ###" * 20 if i % 11 == 0 else "") for i in range(60)] + [None, "short"]
    labels = [(i, int(i % 9 != 0 and i % 11 != 0)) for i in range(0, 60)]
    docs = frame(texts)
    sample = q.forest_sample(q.features(q.rule_statistics(docs)))
    forests = {n: q.fit_forest(sample[list(c)].to_numpy(float)) for n, c in q.FORESTS.items()}

    def by_hand(stats, name):
        n_words, chars, symbols, dup, repeat, lines = stats
        x = {"writing": (symbols / max(chars, 1), min(chars / max(n_words, 1), 50) / 50), "repetition": (dup / max(lines, 1), repeat / max(n_words, 1))}[name]
        total = 0
        for feature, cut, left, right, path, _ in forests[name]["trees"]:
            at = 0
            while feature[at] >= 0:
                at = left[at] if x[feature[at]] < cut[at] else right[at]
            total += path[at]
        return 2 ** (-total / 100 / forests[name]["normal"])

    stats = [(*brute(t), sum(bool(WORD.search(x)) for x in (t or "").split("\n"))) for t in texts]
    left = [i for i, s in enumerate(stats) if s[0] >= 20 and 100 * s[4] <= 30 * s[0]]
    some = set(left)
    all_good, all_bad = (sum(quality == k for i, quality in labels if i in some) for k in (1, 0))
    for name in q.FORESTS:
        score = {i: by_hand(stats[i], name) for i in left}
        known = [(int(score[i] * 2000), quality) for i, quality in labels if i in score]
        best = (-9, 0)
        for b in range(2001):
            lost = sum(x for v, x in known if v > b) / all_good
            caught = sum(1 - x for v, x in known if v > b) / all_bad
            best = max(best, (caught - lost if lost <= 0.01 else -9, -b))
        limit = (1 - best[1]) / 2000 if best[0] >= q.LEAST_GAIN and any(not x for _, x in known) else 2.0
        left = [i for i in left if score[i] < limit]
    rows = q.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {r["doc_id"] for r in rows if r["kept"]} == set(left)
