"""Packing of long texts and of rows that are all alike."""

import collections

from ledgerline.llm import packing

DOCS = "doc_id long, text string, source string, slot long, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS)


def checked(rows, capacity):
    """Bins by their number, after the rules have been held against each."""
    bins = collections.defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for held in bins.values():
        assert sum(r.n_words for r in held) <= capacity
        assert len({r.cluster for r in held}) == len(held)
        sources = [r.source for r in held if r.source is not None]
        assert len(set(sources)) == len(sources)
    return bins


def test_rows_that_are_all_alike_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 64)
    rows = [(None, "one two three", None)] * 600 + [(7, "four five", "s")] * 600 + [(k, f"w{k}", None) for k in range(100, 700)]
    found = packing.pack_documents(frame(spark, rows), 8).collect()
    assert len(found) == 1800
    checked(found, 8)
    by_shard = collections.Counter(r.bin_id >> 32 for r in found)
    assert len(by_shard) == 29 and max(by_shard.values()) < 130


def test_full_pieces_stand_alone(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(n)), f"s{k % 2}") for k, n in enumerate([4000, 10, 3, 20, 0, 7])] + [(9, None, "s")]
    found = packing.pack_documents(frame(spark, rows), 10).collect()
    bins = checked(found, 10)
    places = collections.defaultdict(list)
    for r in found:
        places[r.doc_id].append((r.piece, r.first_word, r.n_words))
    assert sorted(places[0]) == [(k, 10 * k, 10) for k in range(400)] and sorted(places[3]) == [(0, 0, 10), (1, 10, 10)]
    assert places[1] == [(0, 0, 10)] and places[2] == [(0, 0, 3)] and places[4] == places[9] == [(0, 0, 0)]
    assert len(bins) == 404 and {len(b) for b in bins.values()} <= {1, 2}
    assert sum(r.bin_id is None for r in found) == 2
