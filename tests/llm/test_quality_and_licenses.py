import re
from collections import Counter

from sheafray.llm import licenses, quality

TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 500, "l1\nl2\nl1\n\n\nl1", "é ñ ß #*$ %&|<> 12",
    "MIT License and the mit license; apache-license GENERAL public License", "general public\nlicense public license mit", "w\x0bx\x0cy z\x1cq",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation", "licensed under cc by-nc 4.0",
    " ".join(f"w{k}" for k in range(3000)) + " Released under the MIT License.", "İ license Mit LICENSE",
]


def _docs(spark, texts=TEXTS):
    rows = [(k, t, "n_words", 1.0) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string, n_words string, kept double")


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = Counter(windows)
    covered = {p for k, x in enumerate(windows) if often[x] > 1 for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    got = quality.apply_rules(_docs(spark), []).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(TEXTS[r.doc_id])
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)


def test_decision_list_learns_and_prunes():
    zero = dict.fromkeys(quality.FEATURES, 0.0)
    rows = [zero | {"symbol_share": (k % 10) / 100, "mean_word": 5 + k % 3, "bad": False} for k in range(300)]
    rows += [zero | {"symbol_share": 0.3 + k / 1000, "mean_word": 6.0, "bad": True} for k in range(60)]
    rows += [zero | {"symbol_share": 0.01, "mean_word": 12.0 + k % 2, "bad": True} for k in range(60)]
    rules = quality.learn_decision_list(rows)
    assert len(rules) == 2 and {r.conditions[0].feature for r in rules} == {"symbol_share", "mean_word"}
    assert all(len(r.conditions) == 1 and r.covered_good == 0 for r in rules)
    assert sum(any(r.holds(x) for r in rules) for x in rows) == 120
    assert quality.learn_decision_list([]) == [] and quality.learn_decision_list([zero | {"bad": False}] * 9) == []


def test_rules_as_spark_agree_with_python(spark):
    docs = _docs(spark)
    rule = quality.Rule((quality.Condition("n_words", True, 100.0),), 5, 0)
    for r in quality.apply_rules(docs, [rule]).collect():
        assert r.kept == (not r.base_failed and not r.n_words > 100)


def test_fit_and_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    assert rules
    test = quality.apply_rules(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    by = {(r.quality, r.kept): r["count"] for r in test.groupBy("quality", "kept").count().collect()}
    good, bad = by.get((1, True), 0), by.get((0, False), 0)
    assert good / (good + by.get((1, False), 0)) > 0.99 and bad / (bad + by.get((0, True), 0)) > 0.9


def test_stage_keeps_columns(spark):
    docs = _docs(spark, ["w " * 3 + " ".join(f"a{k}" for k in range(60)), "short"])
    out = quality.apply_rules(docs.select("doc_id", "text"), [])
    assert out.where("kept").count() == 2  # the first and its repeat
    assert quality.apply_rules(docs.limit(0), []).collect() == []


def license_counts(text):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at = [(k, label) for words, label in licenses.PHRASES for k in range(len(w)) if tuple(w[k : k + len(words)]) == words]
    found, best = {label for _, label in at}, 1.0 if at else 0.0
    for label, template, marks in licenses.TEXTS:
        tokens = licenses.plain_words(template)
        step = max(licenses.LEAST_STEP, 1 << (len(tokens) - 1).bit_length())
        for i in range(0, max(1, len(w)), step):
            block, own = set(w[i : i + 2 * step]), set(tokens)
            if len(block & own) >= licenses.THRESHOLD * len(own) and set(marks.split()) <= block:
                found.add(label)
                best = max(best, len(block & own) / len(own))
    starts = [k for k, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(found)), best


def test_license_scan(spark):
    got = licenses.scan(_docs(spark)).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == license_counts(TEXTS[r.doc_id])
    assert licenses.scan(_docs(spark).limit(0)).collect() == []


def test_license_texts(spark):
    """Whole texts among other words, with some words lost, and notices that
    only share their form."""
    filler = " ".join(f"word{k}" for k in range(500))
    texts = [f"{filler} {text} {filler}" for _, text, _ in licenses.TEXTS]
    texts += [" ".join(w for k, w in enumerate(text.split()) if k % 9) for _, text, _ in licenses.TEXTS]
    texts += ["licensed under the zlib license version 2 0", "released under the bsd license", "spdx license identifier 2 0 zlib"]
    got = {r.doc_id: r for r in licenses.scan(_docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == license_counts(t)
    for k, (label, _, _) in enumerate(licenses.TEXTS):
        assert label in got[k].labels.split(",")
    assert [got[len(texts) - k].labels for k in (3, 2)] == ["", ""] and "apache" not in got[len(texts) - 1].labels
    own = licenses.scan(_docs(spark, ["Do what you like with these words, friend"]), texts=(("mine", "do what you like with these words", "like"), ("none", " ", "")))
    assert {r.labels for r in own.where("doc_id = 0").collect()} == {"mine"}
