import hashlib
import random
import re

from ledgerlight.llm import secret_scan as s

A = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in A.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_base_spans_and_added_strings(spark):
    rng = random.Random(1)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    random_string = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    syllables = ["tion", "ing", "heit", "ment", "able", "the", "and", "er", "schaft", "ung"]
    name = lambda: "".join(rng.choice(syllables) for _ in range(5))
    rows = []
    for i in range(300):
        words = [name() for _ in range(30)]
        if i % 3 == 0:
            words.insert(5, f'Token = "{hexes(40)}"')
        if i % 7 == 0:
            words.insert(9, "AKIA" + random_string(16).upper())
        if i % 10 == 1:
            words.insert(3, random_string(40))
        rows.append((i, " ".join(words)))
    odd = ["password: token:abcdefg", "api_key='x", "APIKEY==abc.def", "AKIAAKIA" + "B" * 12, "é🙂 secret=ab/cd+ef é " + "a" * 30, "tokentoken:token=secret=abcdefgh", "", None, "deadbeef" * 4000]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [(1000, odd[0]), (None, odd[1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, base string, id int")
    scanned = s.scan(df)
    got = s.digest(scanned).collect()
    want = {d: brute(t) for d, t in rows}
    added = {}
    assert len(got) == len(rows)
    for r in got:
        b = want[r.doc_id]
        text = ",".join(f"{s.KINDS[k]}:{x}:{y}" for x, k, y in b)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == q for _, k, _ in b) for q in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        added[r.doc_id] = r.spans.count("random:")
    assert sum(added[i] for i in range(300) if i % 10 == 1) >= 28
    assert sum(added[i] for i in range(300) if i % 10 != 1) == 0
    assert s.digest(s.scan(df.limit(0))).count() == 0
    clean = dict(scanned.select("doc_id", s.masked(scanned).alias("t")).where("doc_id >= 1000").collect())
    assert clean[1004] == "é🙂 [SECRET] é [SECRET]" and clean[1006] == ""


def brute_added(token, ratios, least=16.0, drop=10.0, mean=0.6, length=16):
    """Spans in one run of candidate characters, by the definition."""
    read = token.lower() if re.fullmatch("[A-Z/_=+-]+", token) else token
    x = [s.ALPHABET.index(c) for c in read]
    out, begin, total, best, end = set(), 0, 0.0, 0.0, 0

    def close():
        if best >= least and best >= mean * (end - begin - 1):
            left = len(re.search("[A-Za-z0-9]*$", token[:begin])[0])
            right = len(re.match("[A-Za-z0-9]*=*", token[end:])[0])
            if end + right - begin + left >= length:
                out.add((begin - left, end + right))

    for i, (a, b) in enumerate(zip(x, x[1:])):
        r = ratios[a * len(s.ALPHABET) + b]
        if total + r <= 0 or best - total - r > drop:
            close()
            begin, total, best, end = i + 1, 0.0, 0.0, i + 1
            continue
        total += r
        if total > best:
            best, end = total, i + 2
    close()
    return out


def test_planted_strings_are_found_among_identifiers_whatever_their_share(spark):
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    secrets = [lambda: some(letters, 24), lambda: some(letters, 32), lambda: some(letters + "+/", 39) + "=", lambda: some(letters + "-_", 32), lambda: f"files/{some(letters, 28)}/index", lambda: f"live_{some(letters, 28)}", lambda: some("abcdefghijklmnopqrstuvwxyz0123456789", 30)]
    nouns = "river mountain forest castle bridge garden teacher hospital music winter yellow silver kitchen hammer pocket butter pepper engine".split()
    w = lambda: rng.choice(nouns)
    plain = [lambda: "_".join(w() for _ in range(4)), lambda: w() + "".join(w().title() for _ in range(3)), lambda: "/".join(w() for _ in range(4)), lambda: f"{w()}-{w()}-2021-0{rng.randrange(1, 9)}-17", lambda: f"{w()}/{w()}/{rng.randrange(3000)}/{w()}-{w()}", lambda: str(rng.randrange(10**17, 10**18)), lambda: "_".join(w().upper() for _ in range(4)), lambda: f"{w()}{w()}{w()}{w()}"]
    for share in (0.02, 0.5):  # the models don't learn from what they are to find
        rows = []
        for i in range(1200):
            bad = rng.random() < share
            rows.append((i, bad, f"so {rng.choice(secrets if bad else plain)()} it is"))
        df = spark.createDataFrame(rows, "doc_id bigint, bad boolean, text string")
        ratios = s.train(s.samples(df))
        got = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in s.scan(df).collect()}
        found = [bool(got[i]) for i, bad, _ in rows if bad]
        wrong = [bool(got[i]) for i, bad, _ in rows if not bad]
        assert sum(found) >= 0.95 * len(found) and sum(wrong) <= 0.01 * len(wrong)
        for i, _, t in rows[:300]:
            token = t.split()[1]
            if not brute(t):
                assert set(got[i]) == ({(a + 3, b + 3) for a, b in brute_added(token, ratios)} if len(token) >= 16 else set())


def test_labelled_strings_may_be_given_and_long_texts_keep_their_places(spark):
    labelled = s.samples(spark.createDataFrame([], "text string"))
    rng = random.Random(8)
    parts = [rng.choice(["ok", f"secret={rng.randrange(10**9, 10**10)}", "é🙂", "a" * 30]) for _ in range(3000)]
    text = " ".join(parts)
    r = s.scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), labelled=labelled).collect()[0]
    assert [(x.start, x.kind, x.end) for x in r.base] == brute(text)
    scanned = s.scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), labelled=labelled)
    assert scanned.select(s.masked(scanned)).first()[0] == " ".join("[SECRET]" if p[:2] in ("se", "aa") else p for p in parts)
