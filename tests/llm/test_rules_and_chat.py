"""Quality ledger, toxicity and chat formatting on small fixtures."""

import collections
import hashlib
import re

import numpy as np
import pytest

from loadstone.llm import chat, quality, toxicity
from tests.llm.helpers import EDGE, documents, words


def measured(text):
    text = text or ""
    w = words(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), sum(hit), text.count("!!")


def test_measures(spark):
    out = quality.ledger(documents(spark)).select("doc_id", *[f"measures.{m}" for m in quality.MEASURES])
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(((i, *measured(t)) for i, t in EDGE), key=repr)


def test_policies_and_ablation(spark):
    texts = [(1, "few"), (2, "same words here " * 40), (3, " ".join(f"w{i}" for i in range(60))), (4, " ".join(f"w{i}##" for i in range(60))), (5, None)]
    docs = documents(spark, texts)
    entries = quality.ledger(docs)
    failed = {r.doc_id: [rule.name for k, rule in enumerate(quality.RULES) if r.failed >> k & 1] for r in entries.collect()}
    assert failed == {1: ["few_words"], 2: ["repeated_words"], 3: [], 4: ["symbols"], 5: ["few_words"]}
    assert {r.doc_id for r in entries.filter(~quality.rejects(quality.BASE)).collect()} == {3, 4}
    assert [r.doc_id for r in quality.keep_good(docs).collect()] == [3]
    assert quality.keep_good(docs).columns == docs.columns
    table = {r.rule: (r.n_failed, r.n_only_this, r.n_kept_without, r.n_documents) for r in quality.ablation(entries, [quality.STANDARD]).collect()}
    assert table["few_words"] == (2, 2, 3, 5) and table["symbols"] == (1, 1, 2, 5) and table["shouting"] == (0, 0, 1, 5)
    assert quality.ledger(docs.filter("false")).count() == 0


def test_no_python_in_the_rules_plan(spark):
    plan = quality.ledger(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.replace("ArrowConvertible", ""))


def brute_segments(places, scores, drift):
    n = max(places) + 1
    line = [-drift] * n
    for p, s in zip(places, scores):
        line[p] = s

    def best(a, z):
        """Best segment of [a, z), shortest and leftmost on ties; recursively all maximal ones."""
        if a >= z:
            return []
        total, options = 0, None
        for i in range(a, z):
            total = 0.0
            for j in range(i, z):
                total += line[j]
                if total > 1e-12 and (options is None or total > options[2] + 1e-9):
                    options = (i, j, total)
        if options is None:
            return []
        return best(a, options[0]) + [options] + best(options[1] + 1, z)

    return best(0, n)


def test_maximal_segments():
    rng = np.random.default_rng(1)
    for _ in range(60):
        places = np.sort(rng.choice(25, size=rng.integers(1, 8), replace=False))
        scores = rng.uniform(0.6, 3.0, len(places))
        mine = toxicity.segments(places, scores, 0.5)
        want = brute_segments(places.tolist(), scores.tolist(), 0.5)
        assert [(a, b) for a, b, _ in mine] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in mine], [s for *_, s in want])


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocabulary, 80))
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                w[rng.integers(80)] = rng.choice(["Vileword", "nastyish!", "nastyous", "(rotten)"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return documents(spark, rows), spark.createDataFrame(labels + [(5, None), (9999, 1)], "doc_id long, toxic int")


def test_held_out_accuracy(spark, toxic):
    docs, labels = toxic
    model = toxicity.learn(docs, labels)
    out = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 600 and 60 < len(held) < 180
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    found = next(r for r in out if r.predicted)
    text = docs.filter(f"doc_id = {found.doc_id}").first().text
    tokens = re.findall(r"[0-9a-zA-Z\x80-￿]+", text)
    assert any(re.match("vile|nasty|rotten", tokens[k].lower()) for p in found.passages for k in range(p["first"], p["last"] + 1))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out)


def test_toxicity_of_awkward_texts(spark, toxic):
    model = toxicity.learn(*toxic)
    docs = documents(spark)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(docs.filter("false"), model).count() == 0
    none = toxicity.learn(docs, toxic[1].filter("false"))
    assert len({r.score for r in toxicity.score(docs, none).collect()}) == 1


CHAT = [
    (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", ""), (1, 3, "assistant", "a\\b<|im_end|>\n<|<"), (2, 0, "assistant", "<"), (2, 0, "assistant", "<"),
    (None, 5, None, "nobody"), (3, 1, "us\ner", "\\"), (3, 0, "assistant", " mark"), (4, None, "assistant", "漢 " * 3000),
]


def test_chat_round_trip(spark):
    rows = CHAT + [(9, k, "assistant" if k % 2 else "user", f"turn {k} <|im_start|>") for k in range(200)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(table)).collect()}
    by = collections.defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((k if k is not None else -1, role or "", text or ""))
    for c, turns in by.items():
        turns = [t[1:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.marked_turns(turns)) and not r.rewritten
    assert chat.format_turns(table.filter("false")).count() == 0


def test_templates_that_rewrite_history():
    def counted(messages):  # the head changes with every turn
        return f"[{len(messages)} turns]\n" + chat.marked_turns(messages)

    def closing(messages):  # only the last turn is open
        return "".join(f"{r}: {t}\n" for r, t in messages[:-1]) + "".join(f"{r}> {t}\n" for r, t in messages[-1:])

    for template, rewrites in ((chat.marked_turns, False), (counted, True), (closing, True)):
        f = chat.Formatter(template)
        assert any([f.add("user", f"t{k}")["rewritten"] for k in range(4)]) == rewrites


def test_spans_of_an_unknown_template():
    f, text = chat.Formatter(lambda ms: "".join(f"<<{r.upper()}>> {t.strip()} </>\n" for r, t in ms)), ""
    for role, said in (("user", "one"), ("assistant", "two two"), ("user", "<")):
        out = f.add(role, said)
        text += out["piece"]
        assert text[out["text_start"] : out["text_end"]] == said and (out["start"], out["end"]) == (len(text) - len(out["piece"]), len(text))


def test_rewriting_after_very_many_turns():
    """Prefixes stay true ones at any length; only a template declared local is restarted."""
    def folding(messages):  # turns before the 70th from the end are folded
        return chat.marked_turns(messages[-70:])

    def numbered(messages):
        return "".join(f"{k} {r}: {t}\n" for k, (r, t) in enumerate(messages))

    turns = [("user", f"t{k}") for k in range(150)]
    f = chat.Formatter(folding)
    assert [f.add(*t)["rewritten"] for t in turns] == [k >= 70 for k in range(150)]
    f = chat.Formatter(numbered)
    assert "".join(f.add(*t)["piece"] for t in turns) == numbered(turns)
    f = chat.Formatter(chat.marked_turns, chat.LOCAL_WINDOW)
    assert "".join(f.add(*t)["piece"] for t in turns) == chat.marked_turns(turns)


def test_law_of_clean_segments():
    """lambda and K: the closed form of a simple walk, and the same scores on a finer grid."""
    p = 0.2
    scores, shares = np.array([-1.0, 1.0]), np.array([1 - p, p])
    assert np.isclose(toxicity._rate(scores, shares), np.log((1 - p) / p))
    for grid in (1.0, 0.25):
        assert np.isclose(toxicity._law_scale(scores, shares, grid), (1 - 2 * p) ** 2 / (1 - p), rtol=1e-4)


def test_calibration_counts_tokens(spark):
    """The law follows the occurrences in clean texts, whatever their length, and the prior all documents."""
    def corpus(copies, more=0):
        texts = [(i, " ".join([f"w{i}x"] * copies + (["vileword"] if i % 5 == 0 or i == 7 else []) + ["plain" if i % 9 else "other"] * copies)) for i in range(200)]
        return documents(spark, texts + [(1000 + k, f"vileword {k}") for k in range(more)])

    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    short, long = (toxicity.learn(corpus(n), labels) for n in (20, 2000))
    assert np.allclose(short.weights, long.weights) and len(short.weights)
    assert long.rate > short.rate * 1.5
    assert abs(short.weights.max() - toxicity.learn(corpus(20, 2000), labels).weights.max()) > 0.5
