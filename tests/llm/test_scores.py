"""Language identification, toxicity, licences, decontamination."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oddgraph.llm import decontaminate, langid, licenses, toxicity

EN, DE = "the house and the garden with water", "das haus und der garten mit wasser"


def test_language(spark, documents):
    docs = documents([EN, DE] * 10 + [None, "", "12 34 !?", "und der hausgarten", EN * 2000], ["en", "de"] * 10 + ["en", None, "de", None, "en"])
    model = langid.fit(docs, F.col("doc_id") < 20)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 20, 21, 22, 23, 24)] == ["en", "de", "und", "und", "und", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[20]["score"] == 0
    kept = langid.identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 22


def plain_scores(train, texts):
    """The definition of the score, word by word, over dictionaries."""
    langs = sorted({lang for _, lang in train})
    counts = {}
    for text, lang in train:
        for w in langid.words_of(text):
            for kind, items in [(0, [w])] + [(n, langid.grams_of(w, n)) for n in range(1, langid.LONGEST + 1)]:
                for x in items:
                    counts.setdefault(kind, {}).setdefault(x, Counter())[lang] += 1
    kept = {k: {x: {g: (c[g] if c[g] >= langid.LEAST_COUNT else 0) + 0.5 for g in langs} for x, c in xs.items() if max(c.values()) >= langid.LEAST_COUNT} for k, xs in counts.items()}
    total = {k: {g: sum(c[g] for c in xs.values()) for g in langs} for k, xs in kept.items()}
    logs = {k: {x: [math.log(c[g] / total[k][g]) for g in langs] for x, c in xs.items()} for k, xs in kept.items()}

    def row(w):
        if w in logs[0]:
            return logs[0][w]
        for n in range(langid.LONGEST, 0, -1):
            if known := [logs[n][x] for x in langid.grams_of(w, n) if x in logs[n]]:
                return [sum(x) / len(known) for x in zip(*known)]
        return [0.0] * len(langs)

    for text in texts:
        words = langid.words_of(text)
        if not words:
            yield "und", 0.0
            continue
        sums = [sum(x) for x in zip(*map(row, words))]
        best = sums.index(max(sums))
        yield langs[best], 1 / sum(math.exp(x - sums[best]) for x in sums)


def test_language_equals_plain_scoring(spark, documents):
    rng = random.Random(8)
    sign = {"en": "abcdefgh", "de": "abcdefuvw", "fr": "abcdéèxyz"}
    make = lambda g, n: " ".join("".join(rng.choice(sign[g]) for _ in range(rng.randrange(1, 6))) for _ in range(n))
    langs = [rng.choice("en de fr".split()) for _ in range(60)]
    texts = [make(g, rng.randrange(1, 30)) for g in langs]
    odd = [None, "", "12 !", "Q", "ÀÉÎ", texts[0], texts[0], make("fr", 5000), "q" * 5000]
    docs = documents(texts + odd, langs + ["en"] * len(odd)).repartition(4)
    model = langid.fit(docs, F.col("doc_id") < 60)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    want = list(plain_scores(list(zip(texts, langs)), texts + odd))
    assert [got[i][0] for i in range(len(want))] == [w for w, _ in want]
    assert [got[i][1] for i in range(len(want))] == pytest.approx([x for _, x in want], abs=1e-3)


def test_language_ties_go_to_the_first(spark, documents):
    docs = documents(["same words here"] * 8, ["b", "a"] * 4)
    got = langid.predict(docs, langid.fit(docs, F.lit(True))).collect()
    assert {(r["lang_pred"], round(r["score"], 6)) for r in got} == {("a", 0.5)}


def test_language_without_training(spark, documents):
    docs = documents([EN, None]).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs, F.lit(True))).collect()} == {"und"}
    assert langid.predict(documents([]), langid.Model(["en"])).count() == 0


def test_folding():
    assert toxicity.fold("You ID10T!  Ｍоrоn") == " you idiot moron"
    assert toxicity.fold("cl­own l0s3r") == " clown loser"
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold(" \n-!") == ""
    assert toxicity.fold("Éé ñ") == " éé ñ"
    assert toxicity.fold("8a6 2oo") == " bag zoo"


def plain_toxicity(text, lexicon):
    """The features by looking for every term at every word, without an automaton."""
    words = toxicity.fold(text).split()
    pairs, total = list(zip(words, words[1:])), 0.0
    for k, w in enumerate(words):
        rest = f" {' '.join(words[k:])} "
        if set(pairs[max(0, k - 1) : k + 1]) & set(lexicon.exceptions):
            continue
        total += max((x for t, x in lexicon.weights.items() if rest.startswith(t)), default=0.0)
    return math.log1p(total), math.log1p(100 * total / len(words) if words else 0.0)


def test_toxicity_against_a_scan_over_all_words(spark, documents):
    """Short words, beginnings, copies, ties, substitutions, long and empty texts."""
    rng = random.Random(8)
    words = "ab xy as ass asset assessment moron moronic morons idiot the house of ox zebra zoo bag".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += ["ab", " ab.ab ", "M0R0N", "8ag 2oo", "аss", None, "", "xy " * 20000, texts[3], texts[3]]
    lexicon = toxicity.Lexicon({" ab ": 2.0, " ass ": 1.5, " asse": 1.0, " moron": 3.0, " moroni": 3.0, " idiot": 2.5, " xy ": 0.5, " bag ": 1.0}, {("the", "idiot"), ("ab", "house"), ("moron", "moron")}, (-1.0, 0.4, 0.3))
    a, b, c = lexicon.curve
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents(texts).repartition(3), lexicon).collect()}
    for i, t in enumerate(texts):
        x, z = plain_toxicity(t, lexicon)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(a + b * x + c * z)))), t
    assert toxicity.score(documents([]), lexicon).count() == 0
    docs = spark.createDataFrame([(None, "ab"), (1, "ab"), (1, "zoo")], "doc_id long, text string")
    assert sorted(round(r["score"], 6) for r in toxicity.score(docs, lexicon).collect()) == sorted(round(1 / (1 + math.exp(-(a + b * x + c * z))), 6) for x, z in (plain_toxicity(t, lexicon) for t in ("ab", "ab", "zoo")))


def test_short_words_are_learned(spark, documents):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["house", "garden", "an", "of"]) for _ in range(20)) + (" zz" if i % 4 == 0 else "") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.fit(documents(texts), labels, F.lit(True))
    assert set(lexicon.weights) == {" zz "}


def test_toxicity(spark, documents):
    rng = random.Random(3)
    words = ["house", "garden", "water", "green", "stone", "table", "river"]
    texts, ys = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(30)]
        y = i % 4 == 0
        if y:
            w[3] = w[17] = rng.choice(["idiot", "moronic", "scumbag"])
        elif i % 8 == 1:
            w[5:7] = ["idiot", "savant"]
        texts.append(" ".join(w))
        ys.append(int(y))
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(ys)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    more = ["house ID1OT water", "Garden M0R0NIC river green", "house garden", None, "", "water " * 20000, "the idiot savant house"]
    docs = documents(texts + more)
    lexicon = toxicity.fit(docs, labels, F.col("doc_id") < 400)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    assert len(got) == 407 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == bool(y) for i, y in enumerate(ys)) >= 396
    assert got[401] >= 0.5 and max(got[402], got[403], got[404], got[405], got[406]) < 0.5
    empty = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert toxicity.score(docs, empty).where("score > 0.01").isEmpty()


def test_licences(spark, documents):
    texts = [
        "Apache License, Version 2.0 and MIT license mit  License", None, "", "mitlicense apache-license", "licensed under CC BY 4.0", "GNU General Public License",
        "gnu general public licence", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "café MIT Éé license MIT License", "x " * 30000 + "mit license",
    ]
    found = {r["doc_id"]: r for r in licenses.scan(documents(texts)).collect()}
    base = {i: sorted((m["start"], m["label"]) for m in r["matches"] if m["base"]) for i, r in found.items()}
    assert base == {0: [(0, "apache"), (6, "mit"), (8, "mit")], 1: [], 2: [], 3: [(1, "apache")], 4: [(2, "cc-by")], 5: [(0, "gpl")], 6: [], 7: [], 8: [(4, "mit")], 9: [(30000, "mit")]}
    assert {m["label"] for m in found[7]["matches"]} == {"mit-text"}
    assert [found[i]["n_words"] for i in (0, 1, 2, 8)] == [10, 0, 0, 6]
    assert licenses.scan(documents([])).count() == 0


def test_licences_that_differ_in_rare_words_equal_a_plain_scan(spark, documents):
    rng = random.Random(7)
    texts = ["released under the Apache License, Version 2.0", "Permission is hereby granted, free of charge, to anyone who gets a copy of this software"]
    for phrase, _, _ in licenses.TEMPLATES:
        words = phrase.split()
        for _ in range(8):
            ws = [rng.choice(["other", "license", "by", w]) if rng.random() < 0.12 else w for w in words]
            texts.append(" ".join(["by"] * rng.randrange(3) + ws + ["license"] * rng.randrange(3) + ws))

    def plain(text):
        ws, out = text.lower().replace(",", " ").replace(".", " ").split(), []
        for phrase, key, label, exact in [(p, p, label, True) for p, label in licenses.BASE] + [(p, k, label, False) for p, k, label in licenses.TEMPLATES]:
            p, k = phrase.split(), key.split()
            at = next(i for i in range(len(p)) if p[i : i + len(k)] == k)
            for i in range(len(ws)):
                same = sum(a == b for a, b in zip(p, ws[i:]))
                if ws[i + at : i + at + len(k)] == k and same >= (len(p) if exact else 0.85 * len(p)):
                    out.append((label, i, exact))
        return sorted(out)

    for r in licenses.scan(documents(texts)).collect():
        assert sorted((m["label"], m["start"], m["base"]) for m in r["matches"]) == plain(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert {m[0] for m in plain(texts[0])} == {"apache", "apache-2.0"}


def test_wand_equals_brute_force():
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 15)))) for i in range(90)]
    index = decontaminate.Index(items, {f"w{i}".encode(): i for i in range(60)}, 1000)
    for _ in range(200):
        words = {f"w{rng.randrange(70)}".encode() for _ in range(rng.randrange(40))}
        scores = [sum(index.impacts.get(w, {}).get(n, 0.0) for w in words) for n in range(len(index.ids))]
        assert [n for n, _ in index.search(words)] == [n for n, s in enumerate(scores) if s >= decontaminate.THRESHOLD - decontaminate.SLACK]


def test_decontamination(spark, documents):
    item = "What is the tallest mountain of the northern island chain?\nIt is the old volcano near the western harbour."
    rest = " ".join(f"filler{i % 97} word{i % 31}" for i in range(300))
    leak = f"{rest} {item.upper()} {rest}"
    texts = [leak, rest, None, "", "What is the tallest mountain of the northern island chain?", leak, "日本 " + item + " Σ", rest * 40]
    bench = spark.createDataFrame([(3, item), (4, item), (5, None), (6, ""), (None, "x y"), (9, "short unique zebra")], "item_id long, text string")
    for group in (2, 20_000):
        found = decontaminate.matches(documents(texts), bench, group_items=group).select("key", "item_id").collect()
        assert {tuple(r) for r in found} == {(d, i) for d in (0, 5, 6) for i in (3, 4)}
    got = {r["doc_id"]: r for r in decontaminate.verdicts(documents(texts), bench).collect()}
    assert len(got) == 8 and got[0]["item_ids"] == [3, 4] and not got[4]["contaminated"] and got[2]["n_items"] == 0
    docs = documents(texts)
    kept = decontaminate.clean(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 7] and kept.columns == docs.columns
    assert decontaminate.clean(docs, bench.where("false")).count() == 8 and decontaminate.verdicts(documents([]), bench).count() == 0


def plain_matches(text, items, frequency, documents):
    """Contaminated items by scoring every passage of every item's own width, term by term."""
    lengths = [len(decontaminate.words_of(t)) for _, t in items]
    mean, words, out = sum(lengths) / len(lengths), decontaminate.words_of(text), set()
    for (item, t), n in zip(items, lengths):
        c, step = Counter(decontaminate.words_of(t)), 1 << (n - 1).bit_length()
        weight = {w: math.log(1 + (documents - frequency.get(w, 0) + 0.5) / (frequency.get(w, 0) + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) for w, f in c.items()}
        q, a = decontaminate.question_and_answer(t)
        for p in range(0, max(1, len(words)), step):
            passage = words[p : p + 2 * step]
            score = sum(x for w, x in weight.items() if w in passage) / sum(weight.values())
            found = lambda part: 1.0 if not part else len(decontaminate.runs(part) & decontaminate.runs(passage, min(5, len(part)))) / len(decontaminate.runs(part))
            if score >= 0.7 - 1e-9 and found(q) >= 0.8 and found(a) >= 0.8:
                out.add(item)
    return out


def test_decontamination_against_every_passage_and_for_every_group(spark, documents):
    rng = random.Random(5)
    line = lambda n, base=300: " ".join(f"w{rng.randrange(base)}" for _ in range(n))
    items = [(i, f"{line(rng.randrange(2, 30))}? {line(rng.randrange(1, 12))}.") for i in range(30)] + [(40, line(400)), (41, "lone"), (42, f"{line(4)}? {line(3)}.")]
    apart = items[-1][1].replace("? ", "? " + line(150) + " ")  # question, 150 other words, answer
    texts = [line(rng.randrange(0, 200)) + " " + rng.choice(items)[1].upper() + " " + line(rng.randrange(0, 200)) for _ in range(40)]
    for _, t in items[:10]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(f"{line(50)} {' '.join(w)} {line(20)}")
    texts += [apart, items[0][1], None, "", line(3000), items[-3][1]]
    docs = documents(texts).repartition(3)
    frequency = Counter(w for t in texts for w in set(decontaminate.words_of(t)))
    want = {(d, i) for d, t in enumerate(texts) for i in plain_matches(t, items, frequency, len([t for t in texts if t is not None]))}
    for chosen in (items, items[:10] + items[-1:]):
        bench = spark.createDataFrame(chosen, "item_id long, text string")
        for group in (1, 7, 20_000) if chosen is items else (20_000,):
            got = {tuple(r) for r in decontaminate.matches(docs, bench, group_items=group).select("key", "item_id").collect()}
            assert got == want if chosen is items else {x for x in got if x[1] == 42} == {x for x in want if x[1] == 42}
    assert len(want) > 40 and not {x for x in want if x[0] == 50}
