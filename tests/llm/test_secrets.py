import hashlib
import math
import random
import re
from collections import Counter

import pytest

from ctxspark.llm.secret_scan import ENTROPY, WINDOW, entropy_spans, find_secrets, redact, scan

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
                    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
TEXTS = ['token = "0123456789abcdef0123"', "PASSWORD:hunter2hunter2 secret: token = abcdefghijklmnop", "AKIAABCDEFGHIJKLMN AKIAAKIA AKIAX" + "Y" * 20,
         "", None, "é" * 30 + " deadbeefdeadbeef feedface", "a" * 16 + "g" + "0" * 15, "ſecret=abcdefghijklmnopq", "api_key='x.y-z=1/2+3456' apikey:short",
         "key Zx8Qp2Lm9Vt4Rw7Yk1Bn5 end", "id 123e4567-e89b-12d3-a456-426614174000", "averylongwordwithoutanydigitsinit", "tOkEn==" + "k9" * 4000]


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_find_secrets_holds_the_base_spans(docs_of):
    r = random.Random(4)
    bits = ["token", "=", " ", ":", '"', "AKIA", "Z9", "deadbeef", "0a1b", "é", "secret", "x", "passwd", ".", "KEY", "api_", "\n", "Qw8"]
    pairs = list(enumerate(TEXTS + ["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(600)])) + [(None, TEXTS[0]), (0, TEXTS[0])]
    got = find_secrets(docs_of(pairs)).collect()
    assert len(got) == len(pairs)
    by = {x["doc_id"]: x for x in got}
    for i, text in pairs:
        x, b = by[i], base(text)
        assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(Counter(k for _, k, _ in b)[k] for k in range(3))
        names = [f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e in b]
        assert x["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [s for s in x["spans"].split(",") if s and not s.startswith("entropy")] == names
    assert find_secrets(docs_of([])).collect() == []


def test_incremental_entropy_equals_counting_each_window():
    r = random.Random(1)
    for _ in range(200):
        s = "".join(r.choice("abcdefGHIJ0123456789" if r.random() < 0.7 else "aa1") for _ in range(r.randint(20, 80)))
        high = [i for i in range(len(s) - WINDOW + 1)
                if -sum(c / WINDOW * math.log2(c / WINDOW) for c in Counter(s[i:i + WINDOW]).values()) >= 3.0 - 1e-9]
        covered = {j for i in high for j in range(i, i + WINDOW)}
        spans = entropy_spans(s, 3.0)
        assert {j for a, b in spans for j in range(a, b)} == covered
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_entropy_and_allow_list():
    secret = "Zx8Qp2Lm9Vt4Rw7Yk1Bn5"
    assert scan(f"key {secret} end") == [("entropy", 4, 25, 4)]
    assert scan(f"key {secret} end", allowed=frozenset([secret])) == []
    assert scan("id 123e4567-e89b-12d3-a456-426614174000") == []
    assert scan("averylongwordwithoutanydigitsinit 12345678901234567890123") == [("hex", 34, 57, 34)]
    assert set(ENTROPY) == {"hex", "alnum", "base64"}


def test_redact_changes_values_alone(docs_of):
    pairs = [(1, 'say token = "0123456789abcdef0123" twice'), (2, "clean"), (3, None), (4, "AKIAABCDEFGHIJKLMN")]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in redact(docs_of(pairs)).collect()}
    assert out == {1: ('say token = "[SECRET]" twice', 28), 2: ("clean", 5), 3: (None, None), 4: ("[SECRET]", 8)}


@pytest.mark.parametrize("text", ["password=aaaaaaaaaaaa", "x" * 100_000 + " token:abcdefabcdef1"])
def test_positions_are_code_points(text):
    (kind, a, b, v), *_ = scan("漢é " + text)
    assert ("漢é " + text)[a:b].startswith(("password", "token")) and v > a
