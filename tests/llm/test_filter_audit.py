from itertools import permutations
import re

from ctxspark.llm import filter_audit as fa


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {i for i, qu, _ in labels if i is not None and qu == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)}
        rows.append((source or "", fails, i in good, i in toxic))
    out = []
    for part in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == part]
        lines, sums = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = [True] * len(mine)
            for k, f in enumerate(order):
                hit = [a and r[1][f] for a, r in zip(alive, mine)]
                late = sum(not a and r[1][f] for a, r in zip(alive, mine))
                alive = [a and not r[1][f] for a, r in zip(alive, mine)]
                sums[f] += sum(hit)
                lines.append((f, (part, "".join(order), k + 1, sum(alive), sum(hit), late,
                                  sum(r[1][f] and sum(r[1].values()) == 1 for r in mine),
                                  sum(h and r[2] for h, r in zip(hit, mine)), sum(h and r[3] for h, r in zip(hit, mine)))))
        out += [(*row, sums[f]) for f, row in lines]
    return sorted(out)


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "x", True) for r in docs], "doc_id long, text string, source string, mask int, part string, first boolean")
    m = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, good int")
    return d.repartition(3), m


def test_audit_equals_brute_force(spark, rng):
    long_text = " ".join(f"w{i}" for i in range(230))
    texts = [None, "", "a b", long_text, long_text + " #", "A" * 30 + " " + long_text, " ".join(["x y z"] * 90), "one $ TWO", "\x0bé ü\t|",
             " ".join(f"word{i}" for i in range(20000))]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", "t", "", None])) for i in range(120)]
    docs += [(None, "a b", "s"), (None, "a b", "s"), (5, docs[5][1], "t"), (5, "other", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (None, 1, 1)]
    got = sorted(map(tuple, fa.audit(*frames(spark, docs, labels)).collect()))
    assert got == brute(docs, labels)
    assert len(got) == 600 * 3


def test_no_documents_and_no_labels(spark):
    d, m = frames(spark, [(1, "a", "s")], [(1, 1, 1)])
    assert fa.audit(d.where("false"), m).collect() == []
    assert sorted(map(tuple, fa.audit(d, m.where("false")).collect())) == brute([(1, "a", "s")], [])
