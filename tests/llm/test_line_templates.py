"""Line templates: what stays, what goes, clashing columns, and the parts against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa

from ledgerline.llm import line_templates
from ledgerline.llm.line_templates import drop_recurring_lines
from ledgerline.llm.words import word_slices

DOCS = "doc_id long, text string, source string, _text_key long, _numbers string, numbers long, class int"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "s", k, "n", 7, 1) for k, t in enumerate(texts)], DOCS)


def word(rng):
    return "w" + "".join(rng.choice("abcdefghij") for _ in range(5))


def sentence(rng, n=10):
    return " ".join(word(rng) for _ in range(n)) + "."


def dropped(spark, texts):
    rows = {r.doc_id: r for r in drop_recurring_lines(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    return [rows[k].n_words_dropped for k in range(len(texts))], [rows[k].text for k in range(len(texts))]


def test_figures_are_no_templates(spark):
    rng = random.Random(2)
    figures = ["\n".join(" ".join(str(rng.randrange(10**6)) for _ in range(8)) for _ in range(5)) for _ in range(6)]
    dates = ["\n".join(f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}-11 {rng.randrange(99)} {rng.randrange(9)} {rng.random()}" for _ in range(6)) for _ in range(6)]
    rows = ["\n".join(f"{rng.randrange(999)} {rng.randrange(999)} {rng.randrange(999)} {word(rng)} {word(rng)}" for _ in range(6)) for _ in range(8)]
    names = ["\n".join(f"{word(rng)} {rng.randrange(999)} {rng.randrange(999)} {rng.randrange(999)}" for _ in range(6)) for _ in range(8)]
    texts = figures + dates + rows + names
    lost, kept = dropped(spark, texts)
    assert lost == [0] * len(texts) and kept == texts


def test_a_template_with_fields_goes(spark):
    rng = random.Random(3)
    texts = [f"{sentence(rng, 30)}\nYour parcel number {rng.randrange(9999)} was sent to the shop near you on day {rng.randrange(30)}\n{sentence(rng, 30)}" for _ in range(5)]
    lost, kept = dropped(spark, texts)
    assert lost == [14] * 5 and not any("parcel" in t for t in kept)


def test_a_long_passage_of_two_documents_goes_and_a_short_one_stays(spark):
    rng = random.Random(4)
    passage, short = " ".join(sentence(rng) for _ in range(8)), " ".join(sentence(rng) for _ in range(4))
    texts = [f"{' '.join(sentence(rng) for _ in range(20))}\n{x}\n{sentence(rng)}" for x in (passage, passage, short, short)]
    lost, kept = dropped(spark, texts)
    assert lost == [80, 80, 0, 0] and kept[2:] == texts[2:] and not any(passage in t for t in kept)


def test_variants_of_one_text_keep_it(spark):
    rng = random.Random(5)
    base = [sentence(rng, 12) for _ in range(20)]
    texts = [" ".join(base)] * 3
    for _ in range(8):
        words = " ".join(base).split()
        for _ in range(6):
            words[rng.randrange(len(words))] = word(rng)
        texts.append(" ".join(words))
    lost, kept = dropped(spark, texts)
    assert sum(lost) == 0 and kept == texts


def test_columns_of_any_name_and_empty_cases(spark):
    rng = random.Random(6)
    passage = " ".join(sentence(rng) for _ in range(3))
    texts = [f"{sentence(rng, 40)} {passage}" for _ in range(4)] + [None, "", "  \n "]
    result = drop_recurring_lines(frame(spark, texts))
    assert result.columns == [*(c.split()[0] for c in DOCS.split(", ")), "n_words_dropped"]
    rows = {r.doc_id: r for r in result.collect()}
    assert [rows[k].n_words_dropped for k in range(7)] == [30] * 4 + [0] * 3 and rows[4].text is None and rows[6].text == "  \n "
    assert all((r._text_key, r._numbers, r.numbers) == (r.doc_id, "n", 7) for r in rows.values())
    assert drop_recurring_lines(frame(spark, [])).count() == 0


def test_records_equal_brute_force():
    rng = random.Random(7)
    texts = []
    for _ in range(200):
        bits = [word(rng) if rng.random() < 0.8 else str(rng.randrange(99)) + rng.choice(["", "x"]) for _ in range(rng.randrange(40))]
        texts.append("".join(b + rng.choice([" ", " ", " ", ". ", "\n", "! "]) for b in bits))
    found, by_leaf, by_segment = [], collections.defaultdict(set), collections.defaultdict(set)
    for words in word_slices(pa.array(texts), 3000):
        text, number, n, leaf, *rest = line_templates.record_table(words)
        found += zip((words.first + text).tolist(), number.tolist(), n.tolist(), leaf.tolist(), *(x.tolist() for x in rest))
    want = []
    for k, text in enumerate(texts):
        records = [r.split() for r in re.split(r"(?<=[.!?])\s+|\n", text) if r.split()]
        want += [(k, j, r) for j, r in enumerate(records)]
    assert len(found) == len(want)
    for (k, j, n, leaf, *rest), (text, number, record) in zip(found, want):
        assert (k, j, n) == (text, number, len(record))
        shown = ["#" if re.search("[0-9]", w) else w for w in record]
        head = min(n, 3)
        cuts = [head + (n - head) * q // 4 for q in range(5)]
        assert rest[4:] == [*(sum(w != "#" for w in shown[a:b]) for a, b in zip(cuts, cuts[1:])), sum(w != "#" for w in shown[:head])]
        by_leaf[leaf].add((n, *shown[:head]))
        for q, (a, b) in enumerate(zip(cuts, cuts[1:])):
            by_segment[(leaf, q, rest[q])].add(tuple(shown[a:b]))
    assert all(len(x) == 1 for x in (*by_leaf.values(), *by_segment.values()))
    assert len(by_leaf) == len({x for s in by_leaf.values() for x in s})


def test_sketches_estimate_similarity():
    rng = random.Random(8)
    words = [word(rng) for _ in range(3000)]
    texts = [" ".join(words)] + [" ".join(words[k:] + [word(rng) for _ in range(k)]) for k in (100, 600, 1500)]
    for slice_ in word_slices(pa.array(texts), 10**7):
        filled, least = line_templates._least_by_bin(slice_)
    assert filled.tolist() == [0, 1, 2, 3]
    for k, gone in ((1, 100), (2, 600), (3, 1500)):
        estimate = (least[0] == least[k]).mean()
        assert abs(estimate - (3000 - gone) / (3000 + gone)) < 0.12
    assert (line_templates._bands(least)[0] == line_templates._bands(least)[1]).any()
    short = next(iter(word_slices(pa.array(["a b c d", "", "a b c d e", "a b c d e"]))))
    filled, least = line_templates._least_by_bin(short)
    assert filled.tolist() == [2, 3] and (line_templates._bands(least)[0] == line_templates._bands(least)[1]).all()
    assert np.array_equal(least[0], least[1])
