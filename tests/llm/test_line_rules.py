"""The frequency verdict of the line rules against brute force."""

import collections
import random
import re

from ledgerline.llm.line_rules import quality_rules

SPACE = "\x20\x09-\x0d"


def normal(line):
    return tuple(re.findall(f"[^{SPACE}]+", re.sub("[1-9]", "0", line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))))


def verdicts(docs, min_docs, share, min_left):
    texts, holders = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, host in docs:
        lines = [normal(x) for x in (text or "").split("\n")]
        if any(lines):
            texts[host or ""].add(text)
        for line in filter(None, lines):
            holders[host or "", line].add(text)
    found = {}
    for key, text, host in docs:
        text, host = text or "", host or ""
        words = re.findall(f"[^{SPACE}]+", text)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
        limit = max(min_docs, share * len(texts[host]))
        gone = sum(len(x) for x in map(normal, text.split("\n")) if x and len(holders[host, x]) > limit)
        failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
        found[key] = (failed, not failed and 1 - (gone / len(words) if words else 0) >= min_left, gone)
    return found


def test_kept_equals_brute_force(spark):
    rng = random.Random(11)
    common = {h: [" ".join(f"{h}x{rng.randrange(50)}" for _ in range(rng.randrange(1, 12))) for _ in range(6)] for h in ("a", "b", None)}
    docs = [(k, t, "a") for k, t in enumerate([None, "", " \n\t\n"])]
    for k in range(3, 260):
        host = rng.choice(["a", "a", "a", "b", None])
        lines = [" ".join(f"w{chr(97 + rng.randrange(26))}{rng.randrange(10**4)}" for _ in range(rng.randrange(1, 15))) for _ in range(rng.randrange(1, 5))]
        lines += [rng.choice([str.upper, str, lambda x: x.replace(" ", "\t ")])(x) for x in rng.sample(common[host], rng.randrange(6))]
        rng.shuffle(lines)
        docs.append((k, "\n".join(lines), host))
    docs += [(300 + k, docs[9][1], docs[9][2]) for k in range(40)]  # copies make no line frequent
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, host string, words long")
    for min_docs, share, min_left in ((10, 0.01, 0.5), (3, 0.3, 0.8)):
        want = verdicts(docs, min_docs, share, min_left)
        found = {r.doc_id: (r.base_failed, r.kept, r.n_removed_words) for r in quality_rules(frame, min_docs, share, min_left).collect()}
        assert found == want
        assert len({v[1] for v in want.values() if not v[0]}) == 2
