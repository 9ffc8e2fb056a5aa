"""Suffix deduplication of rows with null and repeated ids, against brute force."""

import hashlib
import random

from plumbline.llm import suffix_dedup


def test_null_and_repeated_ids(spark):
    random.seed(8)
    line = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    a, b, c = line(250), line(250), line(250)
    rows = [(1, line(150) + a), (None, a + line(200)), (None, b + line(120) + b), (None, line(130) + b), (None, c), (None, c), (None, c + "tail"), (2, a), (None, a), (None, None), (None, "short")]
    rows += [(3, d := line(200) + c[:150]), (3, d), (3, line(180) + d[:120])]
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    seen, done, want = set(), {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, digest(r[1]))):
        raw, cov = (t or "").encode(), set()
        if i is not None and (i, t) in done:
            want.append(done[i, t])
            continue
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                cov.update(range(k, k + 100))
            seen.add(raw[k : k + 100])
        kept = bytes(x for k, x in enumerate(raw) if k not in cov)
        done[i, t] = (i, len(raw), len(cov), sum(k - 1 not in cov for k in cov), hashlib.sha256(kept).hexdigest())
        want.append(done[i, t])
    got = [tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
