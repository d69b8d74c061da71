import base64
import collections
import hashlib
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import cotrain, decontaminate, html_text, lm_score, mixing, quality, secrets, substrings, warc
from rankloom.llm.ngram_join import jaccard_components

WORD = r"[^\x20\x09-\x0D]+"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=120):
    """Texts with exact and near copies, a shared passage, repeats, nulls, blanks, one hot source and a long text."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, base = line(60), line(90)
    out = []
    for k in range(n):
        t = line(r.randint(0, 120))
        if k % 6 == 0:
            ws = base.split()
            for _ in range(r.randint(0, 4)):
                ws[r.randrange(len(ws))] = r.choice(vocab)
            t = " ".join(ws)
        elif k % 7 == 0:
            t = f"{t}\n{passage}\n{line(10)}"
        elif k % 11 == 0:
            t = out[r.randrange(len(out))][1]
        elif k % 13 == 0:
            t = "a b " * 60
        out.append((k, t, "en", "hot" if k % 3 == 0 else f"s{k % 5}", 0))
    out += [(n, None, None, None, None), (n + 1, "", "en", "hot", 0), (n + 2, " \t\n ", "en", "hot", 3), (n + 3, line(4000), "en", "hot", 1), (n + 4, "one two", "en", "s1", 7), (n + 5, "ONE  two", "en", "s1", 8)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


def sets_of(rows, width):
    out = {}
    for i, t, *_ in rows:
        ws = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))} if ws else set()
    return out


def brute_components(sets, num, den):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if den * k >= num * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_jaccard(docs, width, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, width=width, num=num, den=den).collect()}
    sets = sets_of(corpus(), width)
    want = brute_components(sets, num, den)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_near_threshold(spark):
    r = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"g{g}x{k}" for k in range(100)]
        for k in range(8):
            ws = base[:]
            for _ in range(r.randint(0, 6)):
                ws[r.randrange(100)] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(ws), "en", "s", 0))
    got = {x.doc_id: x.component_id for x in jaccard_components(spark.createDataFrame(rows, DOC), width=3, num=9, den=10).collect()}
    assert got == brute_components(sets_of(rows, 3), 9, 10)


def test_substrings(docs):
    rows = corpus()
    words = {i: re.findall(WORD, t or "") for i, t, *_ in rows}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for r in substrings.remove_repeated(docs).collect():
        w = words[r.doc_id]
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))


def test_substrings_seeds_of_a_long_text():
    def seeds(words, width=35):
        s = substrings._Slice(pa.RecordBatch.from_arrays([pa.array([" ".join(words)])], names=["text"]), width)
        return s.grams, s.at, s.seed

    r = random.Random(6)
    for width in (3, 8, 9, 20, 35):
        grams, at, seed = seeds([r.choice("abc") for _ in range(300)], width)
        span = width - min(substrings.PHRASE, width) + 1
        assert seed.tolist() == [min(range(k, k + span), key=lambda p: (grams[p], p)) for k in at.tolist()]
    # more words than 22 bits can number
    grams, at, seed = seeds(map(str, range((1 << 22) + 1000)))
    assert ((seed >= at) & (seed < at + 28)).all()


def test_substrings_come_from_the_automaton():
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(200)) for _ in range(4)]
    s = substrings._Slice(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), 35)
    own, phrases, n = s.seeds()
    assert s.located(pa.array([], pa.binary())).sum() == 0 and s.located(pa.array(phrases, pa.binary())).all()
    words = [w for t in texts for w in t.split()]
    for k in (0, len(phrases) // 2, len(phrases) - 1):
        code = s.code()
        want = {p for p in range(len(words) - 7) if code[2 * p : 2 * p + 16] == phrases[k]}
        assert want and {e - 7 for e in substrings._occurrences([phrases[k]], code.decode())} == want
        assert s.located(pa.array([phrases[k]], pa.binary())).tolist() == np.isin(s.seed, list(want)).tolist()


def test_substrings_many_tasks_and_slices(spark, monkeypatch):
    # windows that one task meets again in a later slice, whole copies, repeats within a text
    passage, rows = " ".join(f"p{k}" for k in range(50)), []
    for k in range(60):
        rows.append((k, " ".join(f"u{k}x{j}" for j in range(40)) + (f" {passage}" if k % 2 else "") + " é" * 3, "en", "s", 0))
    rows += [(100, rows[1][1], "en", "s", 0), (101, (passage + " ") * 3, "en", "s", 0), (102, None, None, None, None)]
    words = {i: re.findall(WORD, t or "") for i, t, *_ in rows}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = substrings.remove_repeated(spark.createDataFrame(rows, DOC).repartition(2)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for r in got:
        w = words[r.doc_id]
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        assert (r.n_words, r.n_removed) == (len(w), len(gone))
    assert substrings.remove_repeated(spark.createDataFrame([], DOC)).count() == 0


def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t, *_ in corpus():
        t = t or ""
        w = re.findall(WORD, t)
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        five = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {p for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_lines(spark):
    own = lambda k: " ".join(f"u{k}x{j}" for j in range(30))
    shared = "All Rights 2024 reserved " + " ".join(f"b{j}" for j in range(90))
    rows = [(k, f"{shared.replace('2024', str(2000 + k))}\n{own(k) if k % 2 else 'a few own words that are not so many here now'}", "en", "h", 0) for k in range(40)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, DOC), least_left=0.2).collect()}
    assert all(got[k].kept == bool(k % 2) and got[k].n_common_words >= 94 for k in range(40))


def test_quality_lines_of_a_large_host(spark, monkeypatch):
    # a notice in fewer than 2 % of the host's documents, broadcast and by a shuffle
    notice = "\n".join(" ".join(chr(97 + k) * j for j in range(3, 9)) for k in range(5))
    rows = [(k, f"{notice}\nown {chr(97 + k % 26) * 4} word" if k % 60 == 0 else " ".join(f"u{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{chr(97 + j)}" for j in range(15)), "en", "big", 0) for k in range(3000)]
    rows += [(k, notice, "en", None if k % 2 else "small", 0) for k in range(5000, 5030)]
    rows += [(5100, rows[0][1], "en", "big", 0)] * 2
    df = spark.createDataFrame(rows, DOC).repartition(3)
    show = lambda: sorted((tuple(r) for r in quality.quality_rules(df).collect()), key=str)
    got = show()
    assert {r[0]: r[-2] for r in got if r[-2]} == {i: 30 for i in [*range(0, 3000, 60), 5100]}
    assert not any(r[-3] for r in got if r[-2]) and all(r[-3] for r in got if r[0] < 3000 and r[0] % 60)
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 0)
    assert show() == got


def test_quality_verdicts_by_brute_force(spark, monkeypatch):
    r = random.Random(7)
    lines = [" ".join(r.choice("abcdefghij") * r.randint(1, 9) for _ in range(r.randint(4, 14))) for _ in range(7)]
    rows = []
    for k in range(300):
        own = [" ".join(f"{r.choice('xyzuvw')}{r.choice('klmn')}{chr(97 + k % 26)}{chr(97 + j)}" for j in range(r.randint(1, 20))) for _ in range(r.randint(0, 4))]
        part = own + [r.choice(lines).upper() if r.random() < 0.3 else r.choice(lines) for _ in range(r.randint(0, 5))]
        r.shuffle(part)
        rows.append((k, r.choice(["", "\n", " "]) + r.choice(["\n", "\n\n", " \r\n"]).join(part), "en", r.choice(["a", "b", None]), 0))
    rows += [(400, None, None, None, None), (401, "", "en", "a", 0), (402, "é " * 50_000, "en", "a", 0), (403, lines[0], "en", "a", 0), (403, lines[0], "en", "a", 0)]
    norm = lambda x: " ".join(re.findall(WORD, re.sub("[0-9]", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in x))))
    count = collections.Counter((h, x) for _, t, _, h, _ in rows for x in {norm(x) for x in (t or "").split("\n")} if x)
    want = []
    for i, t, _, h, _ in rows:
        w = re.findall(WORD, t or "")
        five = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {p for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        left = t if failed else "\n".join(x for x in t.split("\n") if count[h, norm(x)] < 20)
        n = len(re.findall(WORD, left or ""))
        want.append((i, failed, not failed and n >= 10 and n >= 0.3 * len(w), len(w) - n, left))
    df = spark.createDataFrame(rows, DOC + "").withColumnRenamed("n_chars", "kept").repartition(3)
    for limit in (1 << 20, 0):
        monkeypatch.setattr(quality, "BROADCAST_BYTES", limit)
        got = [(x.doc_id, x.base_failed, x.kept, x.n_common_words, x.clean_text) for x in quality.quality_rules(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 50 and sum(not x[1] and not x[2] for x in want) > 10
    assert quality.quality_rules(df.limit(0)).count() == 0


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_secrets(spark):
    num = lambda k: der(2, b"\x01" * k)
    key = base64.b64encode(der(0x30, num(1) + b"".join(num(64) for _ in range(8)))).decode()
    ssh = lambda b: len(b).to_bytes(4, "big") + b
    public = base64.b64encode(ssh(b"ssh-ed25519") + ssh(b"k" * 32)).decode()
    b64 = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    token = f"{b64(json.dumps({'alg': 'HS256'}).encode())}.{b64(b'{}')}.{b64(b's' * 32)}"
    fake = f"eyJ{'a' * 20}.{'b' * 20}.{'z' * 30}"
    texts = [f"é key {key} end", f"x {public}", f"jwt {token} {fake}", "Q" * 400, 'PassWord: "abc123" secret:token:abcdef paſſword=abcdef', "AKIA" + "A" * 16 + " AKIAB " + "0123456789abcdef" * 2, None, ""]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    show = {i: [(s["kind"], texts[i][s["start"] : s["end"]]) for s in v] for i, v in got.items()}
    assert show[0] == [("der_key", key)] and show[1] == [] and show[2] == [("signed_token", token)] and show[3] == []
    assert show[4] == [("assign", 'PassWord: "abc123')]
    assert show[5] == [("access", "AKIA" + "A" * 16), ("hex", "0123456789abcdef" * 2)] and show[6] == show[7] == []
    d = {r.doc_id: r for r in secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert d[5].n_access == d[5].n_hex == 1 and d[5].base_sha256 == hashlib.sha256(b"access:0:20,hex:27:59").hexdigest() and d[7].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert masked[0].text == "é key [secret] end" and masked[6].text is None


def wrap(t, end="\n"):
    return end.join(t[k : k + 64] for k in range(0, len(t), 64))


def private_keys(extra):
    num = lambda k: der(2, b"\x01" * k)
    yield der(0x30, num(1) + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, b"k" * (34 + extra)))
    yield der(0x30, num(1) + b"".join(num(64 + (extra if k == 7 else 0)) for k in range(8)))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\r\\n", "\\\\n", "\n    "])
@pytest.mark.parametrize("extra", range(3))  # with and without padding
def test_secrets_wrapped_keys(extra, end):
    for raw in private_keys(extra):
        key = wrap(base64.b64encode(raw).decode(), end)
        for before, after in ((f"-----BEGIN PRIVATE KEY-----{end}", f"{end}-----END PRIVATE KEY-----{end}"), ('"key": "', f'{end}word and more"'), ("-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"), ("Q" * 64 + end, end + key), (key + f"{end}-----END-----{end}", "")):
            text = before + key + after
            found = [text[s:e] for s, e, kind in secrets.find(text.encode()) if kind == "der_key"]
            assert found == [key] * text.count(key), (before[:20], after[:20])
    ssh = lambda b: len(b).to_bytes(4, "big") + b
    key = wrap(base64.b64encode(b"openssh-key-v1\0" + ssh(b"none") + ssh(b"none") + ssh(b"") + (1).to_bytes(4, "big") + ssh(b"p" * 51) + ssh(b"s" * (135 + extra))).decode().rstrip("="), end)
    for after in (f"{end}words follow", f"{end}-----END OPENSSH PRIVATE KEY-----"):
        assert [(key + after)[s:e] for s, e, kind in secrets.find((key + after).encode()) if kind == "ssh_key"] == [key]


def test_secrets_leaves_public_keys():
    num = lambda k: der(2, b"\x01" * k)
    ssh = lambda b: len(b).to_bytes(4, "big") + b
    for raw in (der(0x30, num(128) + num(3)), der(0x30, der(0x30, der(6, b"\x2b\x65\x70")) + der(3, b"\0" + b"p" * 32)), ssh(b"ssh-ed25519") + ssh(b"k" * 32), b"\x30\x82\x01\x00" + b"q" * 256):
        assert secrets.find(b"x " + base64.b64encode(raw) + b" y") == []
        assert [k for _, _, k in secrets.find(raw.hex().encode())] == ["hex"]


def test_secrets_base_spans_and_long_texts(spark):
    r = random.Random(12)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "  ", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "=.-/+", "deadbeef" * 3, "\u017f", "\u212a"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["é " * 300_000 + "token=abcdefgh", "", None]
    patterns = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 0, 20), ("hex", r"[0-9a-f]+", 0, 0, 24))
    got = {x.doc_id: x for x in secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        # re.A does not keep the long s and the Kelvin sign from folding to s and k
        t = (t or "").replace("\u017f", "é").replace("\u212a", "é")
        spans = [(m.start(), j, f"{kind}:{m.start()}:{m.end()}") for j, (kind, p, flags, g, least) in enumerate(patterns) for m in re.finditer(p, t, flags) if len(m[g]) >= least]
        counts = [sum(x[1] == j for x in spans) for j in range(3)]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == counts, t
        assert got[i].base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(spans)).encode()).hexdigest()
    assert secrets.scan(spark.createDataFrame([], DOC)).count() == 0


def test_html():
    page = """<html><body class="no-sidebar"><div class=menu><a href=x>Home</a></div><header><h1>Site</h1></header><div class="cookie-notice">We use cookies, all of them, OK?</div>
    <div class="post-content"><h2>Title &amp; more</h2><p>First para, with commas, and text that is long enough to be scored.<div>Inner&nbsp;div   text</div><ul><li>one<li>two</ul><p>Short.<script>var t="</p>";</script></div>
    <div class="comments"><p>I liked this, a lot, really very much indeed my friends.</p></div><form><p>Your name, please, and more words here to score.</p></form></body></html>"""
    assert html_text.main_text(page) == "Title & more\nFirst para, with commas, and text that is long enough to be scored.\nInner div text\none\ntwo\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == "" and html_text.main_text("<p>cut <b") == "cut"
    deep = "<div>" * 3000 + "<p>Deep text, that is long enough, to be scored well.</p>"
    assert html_text.main_text(deep) == "Deep text, that is long enough, to be scored well."


PARA = "<p>First para, with commas, and text that is long enough to be scored. And one more sentence of it, for length.</p>"


def test_html_scores_choose_the_container(monkeypatch):
    long = "<p>" + "A sentence of the story, with a comma, of some length. " * 8 + "</p>"
    page = f"<body><article><p>A teaser, that is short and says not much.</p></article><div><div>{long}</div><div>{long}<p>Short.</p></div></div></body>"
    two = f"<body><article><p>A teaser, that is short and says not much.</p></article><article>{long}</article></body>"
    assert html_text.main_text(two).startswith("A sentence") and "teaser" not in html_text.main_text(two)
    assert "teaser" not in html_text.main_text(page) and html_text.main_text(page).endswith("\nShort.") and html_text.main_text(page).count("A sentence") == 16
    # without scores the first article would do
    monkeypatch.setattr(html_text, "COMMAS", re.compile("(?!)"))
    monkeypatch.setattr(html_text, "LEAST_CHARS", 10**9)
    assert html_text.main_text(two) != html_text.main_text(page) == "A teaser, that is short and says not much."


@pytest.mark.parametrize("wrap", ['<div class="content with-sidebar">%s</div>', '<div id="page" class="has-sidebar">%s</div>', '<article class="post comments-open">%s</article>', '<div class="main no-banner">%s</div>', '<main><div class="post-header">%s</div></main>', "<form id=aspnet>%s</form>", '<div class="sidebar-layout">%s<div class="sidebar"><p>Some words of a sidebar, all about nothing.</p></div></div>'])
def test_html_names_are_hints(wrap):
    page = f"<body><nav><a href=x>Home</a></nav>{wrap % PARA}<footer>Foot text that goes on and on, for ever and ever, and is no article at all.</footer></body>"
    assert html_text.main_text(page) == PARA[3:-4]


def test_html_keeps_comments_out():
    comment = "<p>I liked this, a lot, really very much indeed my friends, and I write long comments about it.</p>"
    page = f"<body><div class=post>{PARA}<div class=comments>{comment * 20}</div></div></body>"
    assert html_text.main_text(page) == PARA[3:-4]
    assert html_text.main_text("<body><article></article><footer>Only a footer, with its notes and marks, and nothing else at all here.</footer></body>") == ""


def test_html_points_are_sums_over_paragraphs():
    r = random.Random(3)

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return "<p>" + "word, and more of it " * r.randint(1, 30) + (f"<a href=x>{'link ' * r.randint(1, 9)}</a>" if r.random() < 0.4 else "") + "</p>"
        return f"<{(t := r.choice(['div', 'section']))}>" + "".join(tree(depth - 1) for _ in range(r.randint(1, 4))) + f"</{t}>"

    for _ in range(30):
        nodes, blocks = html_text._parse(f"<body>{tree(5)}</body>")
        html_text._zones(nodes, blocks)
        html_text._score(nodes, blocks)
        want = collections.defaultdict(float)
        for node, text, linked in blocks:
            if len(text) >= html_text.LEAST_CHARS:
                up, part = node.up, (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - linked / len(text))
                while up is not None:
                    want[up] += part
                    up, part = up.up, part * html_text.DECAY
        assert all(np.isclose(x.points, want.get(x, 0.0)) for x in nodes)


def test_html_is_linear_in_depth():
    import time

    for page in ("<div>x " * 50_000, "<div>x " * 50_000 + "</section></b>" * 50_000, "<b><div>x " * 30_000, "<ul><li>x " * 30_000):
        began = time.process_time()
        assert html_text.main_text(page)
        assert time.process_time() - began < 4


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<p>Hello, world of pages and of words.</p>", None)], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).orderBy("page_id").collect()] == [(1, "", 0), (2, "Hello, world of pages and of words.", 35)]


def test_warc(spark, tmp_path):
    big, rows = "<p>é" + "x" * 1200, []
    for k in range(60):
        rows.append((k, f"http://h/{k}", big if k % 10 == 0 else None if k == 7 else "" if k == 8 else f"<p>{k}" * (k + 1)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    base = f"file://{tmp_path}/a"
    files = warc.write(df.repartition(4), base, roll_bytes=2000, shard_bytes=4000)
    again = warc.write(df.repartition(7), f"file://{tmp_path}/b", roll_bytes=2000, shard_bytes=4000)
    show = lambda x: sorted(map(tuple, x.collect()))
    assert files.count() > 3 and show(files) == show(again)
    got = {r.page_id: r for r in warc.read(spark, base).collect()}
    for k, _, h in rows:
        raw = (h or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[k].record_type, got[k].refers_to) == (("revisit", 50) if k % 10 == 0 and k != 50 else ("response", None))
        assert got[k].payload == (None if got[k].refers_to is not None else raw)
    assert warc.write(df.limit(0), f"file://{tmp_path}/c").count() == 0 and warc.read(spark, f"file://{tmp_path}/c").count() == 0


def test_warc_even_shards(spark, tmp_path):
    # an outlying id, many rows without an id, one id many times
    big = "<p>" + "y" * 1500
    rows = [(k, "u", f"<p>{k:05d}" + "x" * 990) for k in range(300)] + [(2**62, "far", "z" * 50), (-5, None, big), (None, "n", big), (None, "n", big), (7, "u", big), (9, "a", "same"), (9, "b", "same")]
    rows += [(None, "n", None)] * 40
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write(df.repartition(5), f"file://{tmp_path}/a", shard_bytes=20_000).collect()
    per = collections.Counter()
    for f in files:
        per[f.shard] += f.records
    assert len(per) >= 14 and max(n for k, n in per.items() if k) <= 23 and sum(per.values()) == len(rows)
    got = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes) for r in got) == sorted((i is None, i or 0, len(h or "")) for i, _, h in rows)
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_bytes == 1503) == sorted([("-5", "revisit", 7), ("7", "response", None), ("None", "revisit", 7), ("None", "revisit", 7)], key=lambda x: (x[0], x[1]))


def test_warc_shard_of_a_key():
    r = random.Random(1)
    keys = sorted({(r.randrange(6), r.randrange(50)) for _ in range(80)})
    starts = [keys[0], *sorted(r.sample(keys[1:], 12))]
    k, d = (np.array(x) for x in zip(*keys))
    assert warc._shard_of(tuple(np.array(x) for x in zip(*starts)), k, d).tolist() == [sum(s <= x for s in starts) - 1 for x in keys]


def edit(ws, item):
    """Least edit distance of item to any stretch of ws."""
    d = [0] * (len(ws) + 1)
    for k, c in enumerate(item, 1):
        row = [k]
        for j, x in enumerate(ws, 1):
            row.append(min(d[j] + 1, row[-1] + 1, d[j - 1] + (x != c)))
        d = row
    return min(d)


def test_decontamination(spark):
    r = random.Random(3)
    vocab = [f"v{k}" for k in range(300)]
    line = lambda k: [r.choice(vocab) for _ in range(k)]
    items = [(k, line(n)) for k, n in enumerate([12, 20, 30, 45, 7])]
    rows = []
    for k in range(120):
        ws = line(80)
        if k % 3 == 0:
            item = items[k % 5][1][:]
            for _ in range(r.randint(0, int(0.2 * len(item)) + 2)):
                p = r.randrange(len(item))
                op = r.randrange(3)
                item[p : p + 1] = [r.choice(vocab)] if op == 0 else [] if op == 1 else [item[p], r.choice(vocab)]
            ws[30:30] = item
        rows.append((k, " ".join(w.upper() + "," if j % 9 == 0 else w for j, w in enumerate(ws))))
    rows += [(200, None), (201, "")]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(9, None), (10, "...")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    want = {}
    for i, t in rows:
        ws = re.findall(r"[a-z0-9]+", (t or "").lower())
        for k, w in items:
            d = edit(ws, w)
            if d <= math.floor(0.2 * len(w) + 1e-9):
                want[i, k] = d
    assert set(got) <= set(want) and all(want[k] <= v for k, v in got.items())
    assert len(got) >= 0.95 * len(want) > 0 and all(k in got for k, v in want.items() if v == 0)


def test_lm(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(["red", "blue", "green"] if k % 2 else ["one", "two", "three"]) for _ in range(40))) for k in range(80)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in lm_score.cross_entropy_difference(df, spark.createDataFrame([(k,) for k in range(1, 40, 2)], "doc_id long")).collect()}
    assert max(got[k].score for k in range(1, 80, 2)) < min(got[k].score for k in range(0, 80, 2))
    assert got[100].score is None and got[101].n_tokens == 0 and np.isclose(got[5].score, got[5].target_loss - got[5].background_loss)
    none = lm_score.cross_entropy_difference(df, spark.createDataFrame([], "doc_id long")).where("score <> 0").count()
    assert none == 0


def test_lm_counts_every_word(spark, monkeypatch):
    # against plain counts, with few frequent words, so that most words and bigrams are counted in shards
    monkeypatch.setattr(lm_score, "SHARD", 500)
    monkeypatch.setattr(lm_score, "PACKET", 300)
    r = random.Random(8)
    vocab = [f"w{chr(97 + k % 26)}{k}x" for k in range(400)]
    rows = [(k, " ".join(vocab[int(r.paretovariate(0.7)) % 400] for _ in range(r.randint(0, 50)))) for k in range(150)]
    rows += [(200, None), (201, ""), (3, "same id w"), (None, "no id w"), (None, "no id w")]
    good = set(range(0, 60, 3))
    words = [(t or "").split() for _, t in rows]
    models = []
    for use in (good, None):
        one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
        for (i, _), w in zip(rows, words):
            if use is None or i in use:
                for v, x in zip([None, *w], w):
                    one[x] += 1
                    two[v, x] += 1
                    before[v] += 1
        models.append((one, two, before, sum(one.values())))
    size = len({x for w in words for x in w})

    def loss(model, w):
        one, two, before, n = model
        p = [(two[v, x] + lm_score.MU * (one[x] + 1) / (n + size)) / (before[v] + lm_score.MU) for v, x in zip([None, *w], w)]
        return -sum(map(math.log, p)) / len(w)

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_score.cross_entropy_difference(df, spark.createDataFrame([(k,) for k in good], "doc_id long"), size=16).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0.0)
    want = sorted(((i, len(w), *((loss(models[0], w), loss(models[1], w)) if w else (None, None))) for (i, _), w in zip(rows, words)), key=key)
    got = sorted(((x.doc_id, x.n_tokens, x.target_loss, x.background_loss) for x in got), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all((a is None) == (b is None) and (a is None or np.isclose(a, b)) for g, w in zip(got, want) for a, b in zip(g[2:], w[2:]))


def test_cotraining(spark):
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        kind = k % 3
        ws = [r.choice(vocab) for _ in range(60)]
        if kind == 1:
            ws[5], ws[40] = "awful", "nasty"
        if kind == 2:
            ws = [w.upper() + "***" for w in ws]
        rows.append((k, " ".join(ws), "en", f"s{r.randrange(4)}", 0))
        if k < 600:
            labels.append((k, 1 if kind == 0 else 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0)]
    df = spark.createDataFrame(rows, DOC)
    got = {x.doc_id: x for x in cotrain.classify(df, spark.createDataFrame(labels, "doc_id long, good int")).collect()}
    right = [got[k].accepted == (k % 3 == 0) for k in range(600, 900)]
    assert sum(right) / len(right) > 0.97 and len(got) == 902
    every = cotrain.classify(df, spark.createDataFrame([(1, 1)], "doc_id long, good int")).where("not accepted").count()
    assert every == 0
    assert cotrain.accepted(df, spark.createDataFrame(labels, "doc_id long, good int")).columns == df.columns


def test_cotraining_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0), (3, None)], "doc_id long, good int")
    assert cotrain.classify(spark.createDataFrame([], DOC), labels).count() == 0
    rows = [(1, "good " * 30_000, "en", "s", 1, "x"), (2, "bad", None, None, None, "y"), (2, "bad too", "en", "s", 3, None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC + ", probability string")
    got = cotrain.classify(df, labels).collect()
    assert len(got) == 4 and cotrain.accepted(df, labels).columns == df.columns
    assert cotrain.classify(df, labels, fit_rows=1).count() == 4


def test_cotraining_counts_and_scores(spark):
    # tables against plain counts; views share no column; weights of near copies add up to one document
    r = random.Random(11)
    rows = [(k, " ".join(r.choice("abcdefgh") * 3 for _ in range(r.randint(1, 12))), r.choice(["en", "de", None]), f"s{k % 3}", r.choice([None, 5, 80])) for k in range(60)]
    rows += [(100 + k, "one text that is here five times or so", "en", "s1", 40) for k in range(5)]
    df = spark.createDataFrame(rows, DOC)
    columns = {"id": "doc_id", "text": "text", "lang": "lang", "source": "source", "length": "n_chars"}
    b = cotrain._source(df, columns).toArrow().combine_chunks().to_batches()[0]
    pairs, words, _ = cotrain._features(b)
    other = cotrain._features(b.set_column(1, "text", pa.array(["x"] * b.num_rows)))[0]
    assert np.array_equal(pairs[1][1], other[1][1]) and not np.array_equal(pairs[0][1], other[0][1])
    keys = [np.unique(k) for _, k in pairs]
    facts = cotrain._facts(cotrain._source(df, columns), keys)
    weights = {x.sign: x.weight for x in cotrain.near_copies(facts).collect()}
    assert 200 in weights.values()
    marked = facts.selectExpr("id", "sign", "words", "content", "metadata", "cast(id % 2 as int) as label", "1000 as weight", "false as apart")
    for k, t in enumerate(cotrain._count(marked, None, keys)):
        ids = b.column(0).to_numpy()[pairs[k][0]]
        for c in (0, 1):
            want = [int((ids[pairs[k][1] == key] % 2 == c).sum()) * 1000 for key in keys[k]]
            assert t[0, c, :-2].tolist() == t[1, c, :-2].tolist() == want
            assert t[0, c, -2] == 1000 * int((b.column(0).to_numpy() % 2 == c).sum())
    held, n = np.array([[4.0, 0.0], [0.0, 9.0]]), np.array([10.0, 90.0])
    odds, gain = cotrain._gain(held, n)
    assert np.allclose(gain, [-4 * math.log(4 / 0.4), 9 * math.log(9 / 8.1)]) and np.isclose(odds[0], math.log((0.5 / 91) / (4.5 / 11)))


def test_cotraining_ties_are_accepted_and_length_is_no_evidence(spark):
    view = cotrain.View(np.array([1, 2], np.uint64), np.array([-5.0, 0.5]), chance=0.001)
    row, at = np.array([0, 0, 1, 2]), np.array([0, 1, 0, 1])
    assert np.allclose(view.score(row, at, np.array([10, 5000, 10])), [-4.49, 0.0, 0.5])


def test_mixing_matches_sql(spark, docs):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.register("documents", docs.toPandas().astype({"text": object, "source": object}))
    want = sorted(map(tuple, c.sql(mixing.oracle(block_tokens=500)).fetchall()))
    got = mixing.mix(docs, block_tokens=500).select("doc_id", "source", "n_tokens", "pass", "block_rank", "rank")
    assert sorted(map(tuple, got.collect())) == want


def test_mixing_rows_without_ids(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(None if k % 3 else k, f"word{k} " * (1 + k % 7), "en", "hot" if k % 2 else None, 0) for k in range(90)] + [(None, "w " * 3000, "en", "a b", 1), (7, "x", "en", "hot", 1), (7, "x y", "en", "hot", 1), (8, None, "en", "hot", 1), (9, " ", "en", "none", 1)]
    df = spark.createDataFrame(rows, DOC).withColumnRenamed("n_chars", "rank")
    c = duckdb.connect()
    c.register("documents", df.toPandas().astype({"text": object, "source": object, "doc_id": "Int64"}))
    want = sorted((tuple(None if v is None or v != v else v for v in x) for x in c.sql(mixing.oracle(block_tokens=40)).fetchall()), key=str)
    got = sorted((tuple(x) for x in mixing.mix(df, block_tokens=40).select("doc_id", "source", "n_tokens", "pass", "block_rank", "rank").collect()), key=str)
    assert got == want and len({x[4] for x in got if x[0] is None}) > 3
    odd = spark.createDataFrame(rows, DOC).withColumnRenamed("text", "a text").withColumnRenamed("source", "the host")
    assert mixing.mix(odd, text_col="a text", source_col="the host").count() > 0


def test_mixing_weights(spark, docs):
    total = {r.source: r.n for r in mixing.mix(docs, max_repeats=1000.0).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert max(total.values()) - min(total.values()) < 4100  # equal quotas, each overshot by less than a text
    assert mixing.mix(docs.limit(0)).count() == 0
    e = mixing.mix(docs, max_repeats=None, target_entropy=0.9)
    assert e.count() > 0


OPERATORS = {
    "html": lambda d: html_text.extract(d, "text", "main"),
    "jaccard": lambda d: jaccard_components(d),
    "secrets": lambda d: secrets.scan(d),
    "redact": lambda d: secrets.redact(d),
    "quality": lambda d: quality.quality_rules(d),
    "leaks": lambda d: decontaminate.leaks(d, d.sparkSession.createDataFrame([(1, "some item text of a few words")], "item_id long, text string")),
    "lm": lambda d: lm_score.cross_entropy_difference(d, d.sparkSession.createDataFrame([(1,)], "doc_id long")),
    "substrings": lambda d: substrings.remove_repeated(d),
    "classes": lambda d: cotrain.classify(d, d.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, good int")),
    "mixing": lambda d: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_clashing_columns(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOC)).count() == 0
    rows = [(1, "a text of a few words, with token=abcdefgh in it", "en", "s", 9), (1, "a text of a few words, with token=abcdefgh in it", "en", "s", 9), (2, None, None, None, None), (None, "", "en", "s", 0), (3, "some item text of a few words " + "é " * 30_000, "en", "s", 9)]
    df = spark.createDataFrame(rows, DOC)
    plain = OPERATORS[name](df)
    more = df
    for c in ("id", "n", "cls", "tid", "sign", "host", "row", "phrase", "words", "html", "spans", "label", "hit", "line", "rep", "gram"):
        more = more.withColumn(c, df["text"])
    own = [c for c in plain.columns if c not in ("id",) or name != "redact"]
    show = lambda x: sorted((str(tuple(r)) for r in x.select(*[c for c in own if c in x.columns]).collect()))
    assert show(OPERATORS[name](more)) == show(plain)
