"""Random keys of every alphabet are found; ordinary names, slugs and paths are not."""

import math
import random
import string

from roadlake.llm import secrets

from .helpers import docs

PLAIN = [
    "getUserAccountInformationFromRemoteService", "internationalization", "AbstractSingletonProxyFactoryBean", "Donaudampfschifffahrtsgesellschaftskapitaen",
    "annual-report-of-the-second-quarter", "----------------------------", "________________________", "well-known-and-well-documented", "either/or/neither/nor/both",
    "CONFIGURATION_FILE_NOT_FOUND", "src/main/java/com/example/Application", "2024-01-15-12-30-45-report", "z" * 40 + "1", "thestatementsofthisstreetareinthetreatiesofthestatesandthenations",
]


def keys():
    rnd = random.Random(4)
    draw = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    low, up, b64 = string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase, string.ascii_letters
    uuid = lambda chars: "-".join(draw(chars, n) for n in (8, 4, 4, 4, 12))
    return {
        "lower": [draw(low, 40) for _ in range(20)], "upper": [draw(up, 40) for _ in range(20)], "uuid": [uuid("0123456789abcdef") for _ in range(20)],
        "upper uuid": [uuid("0123456789ABCDEF") for _ in range(20)], "groups": ["-".join(draw(up, 5) for _ in range(5)) for _ in range(20)],
        "no digit": [draw(b64, 48) for _ in range(20)], "one case": [draw(string.ascii_lowercase, 48) for _ in range(20)],
    }


def test_keys_of_every_alphabet(spark):
    made = [(kind, k) for kind, ks in keys().items() for k in ks]
    rows = [(i, f"use {k} now", "en", "s", 1) for i, (_, k) in enumerate(made)]
    rows += [(1000 + i, f"see {w} here", "en", "s", 1) for i, w in enumerate(PLAIN)]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(docs(spark, rows)).collect()}
    text = {d: t for d, t, *_ in rows}
    seen = {}
    for i, (kind, k) in enumerate(made):
        seen[kind] = seen.get(kind, 0) + any(a <= 4 and b >= 4 + len(k) for a, _, b in found[i])
    assert all(n >= 19 for n in seen.values()), seen
    wrong = [text[d] for d in found if d >= 1000 and found[d]]
    assert not wrong, wrong


def statistics(codes, k):
    """The battery's joint p-value in plain steps, with the normal tail from the error function."""
    n, tail = len(codes), lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    counts = [codes.count(c) for c in range(k)]
    chi = sum((c - n / k) ** 2 / (n / k) for c in counts)
    df = k - 1
    p_chi = tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    up = [2 * c >= k for c in codes]
    high = sum(up)
    runs = 1 + sum(a != b for a, b in zip(up, up[1:]))
    mean = 2 * high * (n - high) / n + 1
    p_runs = 1e-20 if high in (0, n) else 2 * tail(abs(runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)))
    mid = sum(codes) / n
    spread = sum((c - mid) ** 2 for c in codes)
    lagged = sum((a - mid) * (b - mid) for a, b in zip(codes, codes[1:]))
    p_serial = 1e-20 if spread == 0 else 2 * tail(abs(lagged / spread) * math.sqrt(n))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def as_text(body, encoding):
    letters = [c for c in body.lower() if c in secrets.LETTERS]
    if encoding == "hex":
        return (sum(secrets.LETTERS[c] for c in "abcdef") / sum(secrets.LETTERS.values())) ** len(letters)
    total = sum(secrets.LETTERS.values())
    ratio = {c: math.log(26 * n / total) for c, n in secrets.LETTERS.items()}
    mean = sum(n / total * ratio[c] for c, n in secrets.LETTERS.items())
    spread = math.sqrt(sum(n / total * (ratio[c] - mean) ** 2 for c, n in secrets.LETTERS.items()))
    z = (len(letters) * mean - sum(ratio[c] for c in letters)) / (spread * math.sqrt(len(letters)))
    return 0.5 * math.erfc(z / math.sqrt(2))


def test_statistics_and_claims_by_brute_force(spark):
    """Each run's class, verdict of the battery and p-value as text, and the claims, against plain Python."""
    rnd = random.Random(9)
    draw = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    alphabets = {"base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", "base36": string.digits + string.ascii_lowercase, "base32": string.ascii_uppercase + "234567", "hex": string.digits + "ABCDEF"}
    words = "of the report station traffic account winter letter morning service update garden".split()
    runs = []
    for name, chars in alphabets.items():
        for n in (20, 24, 40, 70, 130):
            for _ in range(6):
                body = draw(chars, n)
                runs.append((name, body[:-3] + {"base64": "aZ9", "base36": "z9q", "base32": "Q7Z", "hex": "A9F"}[name]))
    runs += [("base36", ("".join(rnd.choices(words, k=4)) + "2024" + rnd.choice(words))[:40]) for _ in range(40)] + [("base36", "abcdefgh01" * 4)]
    rows = [(i, f"see {body} now", "en", "s", 1) for i, (_, body) in enumerate(runs)]
    found = {r.doc_id: r for r in secrets.scan(docs(spark, rows)).collect()}
    classes = {}
    for i, (name, body) in enumerate(runs):
        plain = body.lower() if name in ("hex", "base36") else body
        alphabet = alphabets[name].lower() if name == "hex" else alphabets[name]
        assert len(body) * math.log2(len(alphabet)) >= secrets.LEAST_BITS
        random_p, text_p = statistics([alphabet.index(c) for c in plain], len(alphabet)), as_text(body, name)
        classes.setdefault((name, int(math.log2(len(body)))), []).append((i, random_p, text_p))
    claimed, unsure = set(), set()
    for group in classes.values():
        ok = sorted((t, i) for i, p, t in group if p >= secrets.FALSE_REJECTIONS)
        last = max((k for k, (t, _) in enumerate(ok, 1) if t * len(group) <= secrets.FALSE_CLAIMS * k), default=0)
        claimed |= {i for _, i in ok[:last]}
        # The normal tail is rounded by 2 per cent and the grid by 12: runs that near a limit may fall on either side.
        unsure |= {i for i, p, t in group if 0.8 < p / secrets.FALSE_REJECTIONS < 1.25 or (last and 0.7 < t / max(ok[last - 1][0], 1e-30) < 1.45) or 0.5 < t * len(group) / secrets.FALSE_CLAIMS / max(last, 1) < 2}
    got = {i for i, r in found.items() if any(s.kind == 3 for s in r.spans)}
    assert got ^ claimed <= unsure and len(unsure) < 40 and len(claimed) > 100
    wordy = {i for i, (_, body) in enumerate(runs) if "2024" in body}
    assert len(got & wordy) <= max(1, 0.05 * len(got))


def test_many_matches_in_one_text(spark):
    """16,000 hex runs and as many keys of another kind in one text: places and redaction in time that grows with them."""
    import time

    text = " ".join(f"{i:016x}" for i in range(16000))
    began = time.time()
    row = secrets.scan(docs(spark, [(1, text, "en", "s", 1)])).collect()[0]
    assert len(row.base) == 16000 and [(s.start, s.stop) for s in row.base[-2:]] == [(15998 * 17, 15998 * 17 + 16), (15999 * 17, 15999 * 17 + 16)]
    out = secrets.redact(docs(spark, [(1, text, "en", "s", 1)])).collect()[0].text
    assert out == " ".join(["[SECRET]"] * 16000)
    assert time.time() - began < 60


def test_overlaps_by_brute_force(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(2)
    kind = "array<struct<start:int,kind:int,stop:int>>"
    for n in (0, 1, 5, 70, 200):
        base = sorted((s, rnd.randrange(3), s + rnd.randrange(1, 90)) for s in rnd.sample(range(3000), n))
        ends, runs = 0, []
        while ends < 3000:
            start = ends + rnd.randrange(1, 20)
            ends = start + rnd.randrange(16, 40)
            runs.append((start, ends, "x"))
        df = spark.createDataFrame([(runs, base)], f"r array<struct<start:int,stop:int,found:string>>, b {kind}")
        got = [(x.start, x.stop) for x in df.select(secrets.uncovered(F.col("r"), F.col("b")).alias("o")).first().o]
        assert got == [(a, b) for a, b, _ in runs if not any(s <= a and b <= e for s, _, e in base)]


def test_keys_around_base_spans_are_redacted_whole(spark):
    """Hexadecimal stretches, access keys and assignments inside longer keys; base spans stay as they are."""
    rnd = random.Random(5)
    key = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)) + "Qx7"
    texts = ["key Zk9Qw3Lm8Xt20123456789abcdefPq7Rs5Tv1Yb4Nc6 end"]
    for _ in range(20):
        hexes = "".join(rnd.choice("0123456789abcdef") for _ in range(16))
        texts += [f"key {key(12)}Z{hexes}{key(12)} end", f"key {key(14)}zAKIA{hexes.upper()}{key(14)} end", f"key password={key(20)} end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert got[0] == "key [SECRET] end"
    # A long stretch of one case is less than random within a key of both, so the battery rejects a few.
    assert sum(t == "key [SECRET] end" for t in got.values()) >= 0.9 * len(texts)
    for r in secrets.scan(df, keep=["doc_id", "text"]).collect():
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
