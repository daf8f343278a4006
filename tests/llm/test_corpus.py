"""Corpus operators against brute force on small tables, and their defined edge cases."""

import collections
import html
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import line_rules, packing, pages, partenum, quality, toxicity
from ledgerline.llm.decontaminate import chain, find_benchmark, without_benchmark
from ledgerline.llm.labelled import held_out
from ledgerline.llm.licences import scan_licences
from ledgerline.llm.line_templates import drop_recurring_lines
from ledgerline.llm.token_counts import TokenCounter, token_counts
from ledgerline.llm.words import unit_starts, word_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, doc_text string, n_words long"


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with those of the operators."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, f"s{k % 3}", "x", k) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


def invented(number):
    return "".join(chr(97 + int(d)) for d in str(number))


def prose(rng, n, vocabulary=400):
    return " ".join("w" + invented(rng.randrange(vocabulary)) for _ in range(n))


def varied(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "v" + invented(rng.randrange(10**6))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [None, "", "   \n", "one", "One", "a b c d", "a b c d e", "é x y", "A\tB\nc\x0bd\x0ce"]
    texts += [prose(rng, rng.randrange(3, 300), 5000) for _ in range(60)]
    base = prose(rng, 200, 5000)
    texts += [varied(rng, base, k % 7) for k in range(40)] + [base] * 5
    passage = prose(rng, 60, 5000)
    texts += [f"{prose(rng, rng.randrange(20, 120), 5000)} {passage} {prose(rng, 20, 5000)}" for _ in range(40)]
    texts += [prose(rng, 20, 3) for _ in range(20)] + [prose(rng, 20000, 50000)] * 2
    return texts


def test_words_match_the_pattern(corpus):
    texts = corpus + ["x" * 10]
    for limit in (1, 1000, 10**7):
        found, hashes = [], []
        for words in word_slices(pa.array(texts, pa.string()), limit):
            h = words.hashes()
            for a, b in zip(words.bounds[:-1], words.bounds[1:]):
                found.append([bytes(words.data[s:e]).decode() for s, e in zip(words.starts[a:b], words.ends[a:b])])
                hashes.append(h[a:b].tolist())
        assert found == [WORD.findall(t or "") for t in texts]
        by_hash = collections.defaultdict(set)
        for ws, hs in zip(found, hashes):
            for w, h in zip(ws, hs):
                by_hash[h].add(lower(w))
        assert all(len(x) == 1 for x in by_hash.values())


def shingles(text):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(sets):
    root = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near_duplicates_equal_brute_force(spark, corpus):
    sets = [shingles(t) for t in corpus]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.near_duplicates(frame(spark, corpus)).collect()}
    assert found == {k: (len(s), c) for k, (s, c) in enumerate(zip(sets, components(sets)))}


def test_near_duplicates_edges(spark):
    assert partenum.near_duplicates(frame(spark, [])).count() == 0
    rows = partenum.near_duplicates(frame(spark, ["a b", "A b", None, "a b"], [4, 4, 5, None])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(4, 4), (4, 4), (5, 5)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 9, 14, 30, 80, 300]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            gone = rng.integers(0, len(a) // 4 + 1)
            most = (len(a) - gone) * 4 // 3 - (len(a) - gone)
            more = rng.integers(0, max(most - gone, 0) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, more).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and 4 * both >= 3 * (len(a) + len(b) - both):
                x, y = ({int(s) for _, values, _ in partenum.signatures(z) for s in values} for z in (a, b))
                assert x & y


def test_line_rules_base_figures(spark, corpus):
    rng = random.Random(9)
    texts = corpus[:-2] + ["x y z\nx y z\n \nx y z\nw #1 $", " ".join(["a b c d e f g h i"] * 4), "#*$%&|<> é"]
    texts += [" ".join([prose(rng, 8, 4)] * rng.randrange(1, 4) + [prose(rng, 9, 3)]) for _ in range(30)]
    found = {r.doc_id: r for r in line_rules.quality_rules(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        text = text or ""
        words = WORD.findall(text)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(inside) > 30 * len(words))


def test_line_rules_reject_depleted_documents(spark):
    rng = random.Random(2)
    menu = "home about contact news sport weather travel food money culture opinion video"
    texts = [f"{menu}\n{prose(rng, 10, 9999)}" for _ in range(15)] + [prose(rng, 40, 9999)] * 20
    docs = spark.createDataFrame([(k, t, "host") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in line_rules.quality_rules(docs).collect()}
    assert not any(kept[k] for k in range(15)) and all(kept[k] for k in range(15, 35))
    assert line_rules.quality_rules(docs.limit(0)).count() == 0


def test_page_text(spark):
    article = "<article><h1>T &amp; x</h1><p>One <b>two</b>\n three<br>four<p>five</article>"
    page = f"<html><head><script>var a='<p>no</p>'</script></head><body><nav><li>Menu</li></nav><div class='ad'>Buy</div>{article}<footer>F</footer>"
    rows = [(1, "http://h/a/1", page), (2, "http://h/a/2", None), (3, None, ""), (4, "http://g/x/1", "<div>Top line</div><p>Own one</p>"),
            (5, "http://g/x/2", "<div>Top line</div><p>Other text here</p>"), (6, "http://g/x/2", "<p>Other text here &copy")]
    found = {r.page_id: (r.text, r.n_chars) for r in pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {1: "T & x\n\nOne two three four\n\nfive", 2: "", 3: "", 4: "Own one", 5: "Other text here", 6: "Other text here ©"}
    assert {k: v[0] for k, v in found.items()} == want and all(len(t) == n for t, n in found.values())


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        best = max(n for n in range(len(a) + 1) for c in itertools.combinations(range(len(a)), n)
                   if (it := iter(b)) is not None and all(a[k] in it for k in c))
        found = sorted(pages.shared_lines(a, b))
        it = iter(b)
        assert len(found) == best and all(a[k] in it for k in found)


def test_recurring_lines_go_and_copies_stay(spark):
    rng = random.Random(4)
    sentences = [" ".join("p" + invented(rng.randrange(9999)) for _ in range(9)) + "." for _ in range(7)]
    passage = " ".join(sentences)
    own = [prose(rng, 100, 9999) + "." for _ in range(12)]
    texts = [f"{own[k]} {passage}\nOrder number {k}77 was sent to you on day {k}9." for k in range(6)] + own[6:9] + [own[9]] * 5 + [None, "", own[10], own[10]]
    result = drop_recurring_lines(frame(spark, texts))
    assert result.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "n_words_dropped"]
    found = {r.doc_id: r for r in result.collect()}
    for k in range(6):
        assert found[k].text.strip() == own[k] and found[k].n_words_dropped == 63 + 10
    assert all(found[k].text == texts[k] and found[k].n_words_dropped == 0 for k in range(6, len(texts)))
    assert drop_recurring_lines(frame(spark, [])).count() == 0


def test_carriers_that_are_no_copies_lose_their_templates(spark):
    rng = random.Random(14)
    passages = [" ".join(" ".join("p" + invented(rng.randrange(9999)) for _ in range(10)) + "." for _ in range(10)) for _ in range(3)]
    own = [prose(rng, 50, 9999) + "." for _ in range(6)]
    carriers = [f"{x} {passages[0]}" for x in own]
    stacked = [f"{prose(rng, 30, 9999)}. {passages[k % 3]} {prose(rng, 30, 9999)}. {passages[(k + 1) % 3]}" for k in range(9)]
    story = " ".join(" ".join("q" + invented(rng.randrange(9999)) for _ in range(10)) + "." for _ in range(10))
    copies = [f"{story} Unlike the {k * 'x'}y one" for k in range(4)]
    found = {r.doc_id: r for r in drop_recurring_lines(frame(spark, carriers + stacked + copies)).collect()}
    assert all(found[k].text.strip() == own[k] and found[k].n_words_dropped == 100 for k in range(6))
    assert all(found[k].n_words_dropped == 200 for k in range(6, 15))
    assert all(found[k].text == copies[k - 15] and found[k].n_words_dropped == 0 for k in range(15, 19))


def test_benchmark_passages(spark):
    items = [(1, "A train leaves the station at 60 km per hour and reaches Springfield after 3 hours of steady travel along the coast."),
             (2, "too short"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = "A train leaves the station at 85 km per hour and reaches Riverton after 7 hours of steady travel along the coast."
    clash = "A train leaves the station at 85 km per hour or slower and some say it stops at each halt on the way."
    texts = [f"Some words first. {items[0][1]} And after.", f"Intro here. {near}", clash, "nothing of that kind at all", None, "", "it is too short indeed"]
    docs = frame(spark, texts)
    found = sorted((r.doc_id, r.item_id, r.reparameterised) for r in find_benchmark(docs, bench).collect())
    assert found == [(0, 1, False), (1, 1, True), (6, 2, False)]
    assert sorted(r.doc_id for r in without_benchmark(docs, bench).collect()) == [2, 3, 4, 5]
    assert find_benchmark(docs.limit(0), bench).count() == find_benchmark(docs, bench.limit(0)).count() == 0


def test_benchmark_copies_cut_into_diagonals_or_in_another_case(spark):
    items = [(1, "we asked the old keeper of Springfield how many boats came into the small harbour before noon and he told us of Edwin "
                 "and the long grey ships that used to wait there for better weather"),
             (2, "Berlin 1945"), (3, "12 14 19 23 31 44 58 61 70 82"), (4, "The Quick Tall Grey Wolf Near Old Stone Mill Road")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = items[0][1]
    longer = text.replace("Springfield", "New Haven Town").replace("Edwin", "Mary Ann").replace("boats came", "boats often came")
    shorter = text.replace("how many boats", "how boats").replace("he told us", "he told").replace("small harbour before", "small before")
    one_name = text.replace("Springfield", "Riverton")
    texts = [text, longer, f"so {text.lower()} yes", text.upper(), one_name.lower(), one_name.upper(), shorter,
             "they left berlin 1945 for good", "Berlin 1946", items[2][1], items[2][1].replace("1", "9"), items[3][1].lower(), items[3][1],
             "we asked the old keeper of nothing at all and then the long grey ships went by"]
    found = sorted((r.doc_id, r.item_id) for r in find_benchmark(frame(spark, texts), bench).collect())
    assert found == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 2), (9, 3), (11, 4), (12, 4)]


def test_chains_add_up_ordered_diagonals():
    agree = np.zeros((12, 3), dtype=np.int64)
    agree[:4, 1] = agree[4:8, 2] = agree[8:, 0] = 1
    assert len(chain(agree, np.array([2, 5, 6]))) == 8  # the third diagonal would go back in the document
    assert len(chain(agree, np.array([4, 5, 6]))) == 10  # two words of the item are lacking
    agree[:, :] = [[0, 1, 0]]
    assert chain(agree, np.array([2, 5, 6])) == [(k, 1) for k in range(12)]


def test_benchmark_in_several_blocks(spark, monkeypatch):
    items = [(k, " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(12))) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [f"before it {items[k % 6][1]} behind it" if k % 3 else "clean words of its own only" for k in range(12)])
    monkeypatch.setattr("ledgerline.llm.decontaminate.BLOCK_ITEMS", 2)
    found = sorted((r.doc_id, r.item_id) for r in find_benchmark(docs, bench).collect())
    assert found == [(k, k % 6) for k in range(12) if k % 3]
    assert sorted(r.doc_id for r in without_benchmark(docs, bench).collect()) == [0, 3, 6, 9]


def test_slots_must_be_filled_one_to_one(spark):
    bench = spark.createDataFrame([(1, "add 12 apples to 12 pears and then take 30 plums away from the heap now")], "item_id long, text string")
    same = "add 55 apples to 55 pears and then take 91 plums away from the heap now"
    other = "add 55 apples to 56 pears and then take 91 plums away from the heap now"
    assert [r.doc_id for r in find_benchmark(frame(spark, [same, other]), bench).collect()] == [0]


def test_packing_is_best_fit_under_conflicts(spark):
    rng = random.Random(8)
    lengths = sorted((rng.randrange(1, 100) for _ in range(300)), reverse=True)
    sources = [rng.choice(["hot", "a", "b", "c", None]) for _ in lengths]
    clusters = [rng.randrange(200) for _ in lengths]
    found = packing.pack(lengths, sources, clusters, 100)
    bins = []
    for length, source, cluster, number in zip(lengths, sources, clusters, found):
        fits = [b for b in bins if b["left"] >= length and (source is None or source not in b["sources"]) and cluster not in b["clusters"]]
        if fits:
            assert bins[number]["left"] == min(b["left"] for b in fits) and bins[number] in fits
        else:
            assert number == len(bins)
            bins.append({"left": 100, "sources": set(), "clusters": set()})
        b = bins[number]
        b["left"] -= length
        b["sources"].add(source)
        b["clusters"].add(cluster)


def test_packing_keeps_every_word(spark, corpus):
    rows = packing.pack_documents(frame(spark, corpus), 256).collect()
    for k, text in enumerate(corpus):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert sum(r.n_words for r in own) == len(WORD.findall(text or ""))
        assert [r.first_word for r in own] == [256 * i for i in range(len(own))]
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    assert all(r.n_words == 0 for r in bins.pop(None))
    for own in bins.values():
        assert sum(r.n_words for r in own) <= 256
        assert len({r.source for r in own}) == len({r.cluster for r in own}) == len(own)
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_licences(spark):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\n\n"
    from ledgerline.llm.licences import _MIT_GRANT

    texts = [mit + _MIT_GRANT.upper(), "Prose here.\nreleased under the MIT licence!\nmore", None, "", "free text"]
    found = {r.doc_id: (r.license_id, r.notices) for r in scan_licences(frame(spark, texts)).collect()}
    assert found == {0: ("MIT", ""), 1: (None, "MIT"), 2: (None, ""), 3: (None, ""), 4: (None, "")}
    assert scan_licences(frame(spark, [])).count() == 0


def test_token_counts_equal_the_library(spark, corpus):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("word_bpe_49k.json")
    texts = corpus + ["<|endoftext|>x y<|startoftext|> <|endoftext|", "don't I'll x's --'s a1b22", "é ́a \x1c\x85\xa0b 日本語 🎉 İ ΑΣ ﬁ K", "ÀÉ²½ªß"]
    library = TokenCounter(path).library
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    found = {r.doc_id: r for r in token_counts(frame(spark, texts), path).collect()}
    assert [found[k].n_tokens for k in range(len(texts))] == want
    assert [found[k].n_bytes for k in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert [found[k].over_limit for k in range(len(texts))] == [n > 2048 for n in want]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_ranks_held_out_documents(spark):
    rng = random.Random(6)
    texts = [f"{prose(rng, 80, 900)}." if k % 3 else " | ".join(prose(rng, 60, 900).split()) for k in range(600)]
    docs = frame(spark, texts + [None, ""])
    rows = quality.score_quality(docs, labels_of(spark, [(k, int(k % 3 > 0), 0) for k in range(600)])).collect()
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < 200 and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert len(rows) == 602 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score_quality(docs, labels_of(spark, [])).collect()} == {0.5}


def test_quality_learns_from_documents_without_a_label(spark):
    rng = random.Random(16)
    texts = [f"{prose(rng, 80, 900)}." if k % 3 else " | ".join(prose(rng, 60, 900).split()) for k in range(900)]
    docs = frame(spark, texts)
    good = [(k, 1, 0) for k in range(0, 900, 2) if k % 3]
    model = quality.train_quality(docs, labels_of(spark, good))
    assert abs(model.prior - 2 / 3) < 0.1
    rows = quality.score_quality(docs, labels_of(spark, good)).collect()
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in rows if r.held_out]) > 0.95
    bad = [(k, 0, 0) for k in range(0, 900, 6)]
    assert {r.doc_id: r.score for r in quality.score_quality(docs, labels_of(spark, good + bad)).collect()} == {r.doc_id: r.score for r in rows}


def test_prior_is_the_share_of_positives():
    rng = np.random.default_rng(0)
    unlabelled = np.concatenate([rng.normal(2, 1, 3000), rng.normal(-4, 1, 2000)])
    assert abs(quality.estimate_prior(rng.normal(2, 1, 4000), unlabelled) - 0.6) < 0.05


def test_toxicity_finds_documents_and_sentences(spark):
    rng = random.Random(7)
    texts = [". ".join(prose(rng, 9, 300) + (" vile" if k % 4 == 0 and j == 2 else "") for j in range(5)) + "." for k in range(400)]
    docs = frame(spark, texts + [None, ""])
    rows = toxicity.score_toxicity(docs, labels_of(spark, [(k, 1, int(k % 4 == 0)) for k in range(400)])).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(r.offending == [2] for r in held if r.predicted and r.doc_id % 4 == 0)
    assert {r.score for r in rows if r.doc_id >= 400} == {0.0}


def test_length_alone_is_not_toxic(spark):
    rng = random.Random(11)
    texts = [". ".join(prose(rng, 9, 300) + (" vile" if k % 4 == 0 and j == 2 else "") for j in range(5)) + "." for k in range(400)]
    long = ". ".join(prose(rng, 9, 300) for _ in range(5000)) + "."
    docs = frame(spark, texts + [long, f"{long} A vile one."])
    trained = labels_of(spark, [(k, 1, int(k % 4 == 0)) for k in range(400)])
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, trained).collect()}
    assert found[400].predicted == 0 and found[400].score < 0.1 and found[400].offending == []
    assert found[401].predicted == 1 and found[401].offending == [5000]
    one_kind = labels_of(spark, [(k, 1, 0) for k in range(400)])
    for labels in (one_kind, one_kind.limit(0)):
        assert {r.score for r in toxicity.score_toxicity(docs, labels).collect()} == {0.0}
        assert toxicity.without_toxic(docs, labels).count() == 402


def test_noisy_or_is_the_product():
    p, text = np.array([0.2, 0.5, 0.1]), np.array([0, 0, 2])
    assert np.allclose(toxicity.noisy_or(p, text, 3), [1 - 0.8 * 0.5, 0, 0.1])


def test_held_out_fold(spark):
    import zlib

    found = spark.range(200).select("id", held_out("id", 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in found)


def test_sentences_end_at_marks_and_lines():
    words = next(word_slices(pa.array(["One two. Three\nfour", "", "five"])))
    assert unit_starts(words).tolist() == [0, 2, 3, 4]
    assert html.unescape("&amp;") == "&"
