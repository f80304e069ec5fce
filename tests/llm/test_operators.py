"""Each operator against a plain version of itself, and on nulls, empty and very long texts, ties and repeated rows."""

import hashlib
import html
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tableproof.llm import crf_langid, decontaminate, host_quality, html_template, line_spread, mixing, near_dedup, pii_segments, secrets, url_filter

DOCS = "doc_id long, text string, source string, lang string, row string, id long, version string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names the operators use themselves."""
    rng = random.Random(1)
    copy = prose(rng, 60)
    rows = [(1, None, "a", None), (2, "", "a", "en"), (3, "   \n\t ", None, None), (4, copy, "a", "en"), (5, copy, "b", None), (5, copy, "b", None), (6, copy + " more", None, "en"), (7, "é" * 5, "b", "fr"), (None, "null id text", "a", "en"), (8, prose(rng, 30_000), "c", "en"), (9, "x" * 200_000, "c", None), (10, copy, "a", "en")]
    return spark.createDataFrame([(i, t, s, lang, "r", 0, "v") for i, t, s, lang in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# -- mixing ----------------------------------------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 400)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    # water filling in plain steps
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, want = 1.5 * sum(size.values()), set(order), {}
    while free:
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 2 * size[s]}
        if not over:
            want |= level
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= 2 * size[s]
        free -= over
    source_of = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[source_of[r["doc_id"]]])
        taken[source_of[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)


def test_mix_odd(odd, none):
    got = {r["doc_id"]: r for r in mixing.mix(odd).collect()}
    assert mixing.mix(odd).count() == odd.count()
    assert got[1]["size"] == got[2]["size"] == got[3]["size"] == 0 and got[1]["taken"] == 0
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(odd).columns[: len(odd.columns)] == odd.columns


# -- decontamination -------------------------------------------------------------------------------------------------


def test_templates(spark):
    items = spark.createDataFrame([(1, "Tom Miller has 12 apples and gives 5 apples to his friend before he walks 12 km home with the rest of them"), (2, None), (3, "4 + 4")], "item_id long, text string")
    docs = [
        (1, "ah Anna has 31 apples and gives 8 apples to his friend before he walks 31 km home with the rest of them so"),
        (2, "ah Anna has 31 apples and gives 31 apples to his friend before he walks 7 km home with the rest of them so"),
        (3, "TOM MILLER HAS 12 APPLES AND GIVES 5 APPLES TO HIS FRIEND BEFORE HE WALKS 12 KM HOME WITH THE REST OF THEM"),
        (4, "Tom Miller has 12 apples in a bag"),
        (5, "4 + 4"),
        (6, None),
        (7, ""),
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, item string")
    got = {r["doc_id"]: r for r in decontaminate.judge(docs, items).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {1, 3}
    assert got[1]["item_id"] == 1 and got[2]["n_items"] == 0
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [2, 4, 5, 6, 7]


def test_templates_of_few_words(spark):
    """Items without a window of plain words, or of under five tokens, are found verbatim, inside longer texts too."""
    items = spark.createDataFrame([(1, "Calculate 12 + 7 * 3"), (2, "name the red planet"), (3, "12 13 14 15 16 17 18"), (4, "Tom Lee visits Paris"), (5, "one two three four five six")], "item_id long, text string")
    docs = ["so calculate 12 + 7 * 3 now please", "Calculate 12 + 8 * 3", "Please name the red planet for us", "name the red planets", "see 12 13 14 15 16 17 18 and 19", "12 13 14 15 16 17 180", "then TOM LEE VISITS PARIS again", "Calculate 12 + 7 * 3", "name the red planet", "and one two three four five six", None]
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["n_items"]) for r in decontaminate.judge(docs, items).collect()}
    assert got == {0: (1, 1), 1: (None, 0), 2: (2, 1), 3: (None, 0), 4: (3, 1), 5: (None, 0), 6: (4, 1), 7: (1, 1), 8: (2, 1), 9: (5, 1), 10: (None, 0)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [1, 3, 5, 10]


def test_templates_odd(odd, none, spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert decontaminate.judge(odd, items).where("contaminated").count() == 0
    assert decontaminate.judge(none, items).count() == 0
    assert decontaminate.clean(odd, items.limit(0)).count() == odd.count()


# -- urls ------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x", "http://a.net/x", "http://a.net", "https://b.example.com/de/?x", "http://x.org/fr/y#z", "http://x.org/porn/", "http://x.org/pornography", "http://bet.org/poker/cheap", "http://x.org/bet", None, "no scheme/porn", ""]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(5)] == [("a.example.net", "/en/x", "example.net/en/", "allow"), ("a.net", "/x", "net/", "block"), ("a.net", "", None, "allow"), ("b.example.com", "/de/", "example.com/de/", "block"), ("x.org", "/fr/y", "org/fr/", "allow")]
    assert [got[i]["verdict"] for i in range(5, 12)] == ["block", "allow", "block", "allow", "allow", "block", "allow"]
    assert (got[9]["host"], got[9]["path"]) == ("", "")


# -- language --------------------------------------------------------------------------------------------------------

EN = "the house is on the hill and it was the best of all that we have seen this year with our friends".split()
FR = "la maison est sur la colline et elle était la plus belle que nous avons vue cette année avec nos amis".split()


def test_language_field(spark):
    rng = random.Random(3)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(EN if i % 2 else FR, 60), "en" if i % 2 else "fr") for i in range(200)]
    rows += [(1000, None, None), (1001, "123 --", None), (1002, text(EN, 30) + " " + text(FR, 10), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("row", F.lit(1))
    got = {r["row"]["doc_id"]: r for r in crf_langid.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:200])
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["score"] == 0
    assert got[1002]["lang_pred"] == "en" and 0.65 < got[1002]["score"] < 0.85
    kept = crf_langid.readable(docs)
    assert kept.columns == docs.columns and kept.count() == 201


def test_language_posteriors_are_exact():
    import numpy as np

    rng = np.random.default_rng(5)
    emit, moves, start = rng.normal(size=(37, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.zeros(37, bool)
    first[[0, 10, 11]] = True
    got = crf_langid.forward_backward(emit, first, moves, start, block=4)
    for lo, hi in ((0, 10), (10, 11), (11, 37)):
        e = np.exp(emit[lo:hi])
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        alpha[0] = np.exp(start) * e[0]
        for t in range(1, len(e)):
            alpha[t] = (alpha[t - 1] @ np.exp(moves)) * e[t]
        for t in range(len(e) - 2, -1, -1):
            beta[t] = np.exp(moves) @ (e[t + 1] * beta[t + 1])
        want = alpha * beta
        assert np.allclose(got[lo:hi], want / want.sum(axis=1, keepdims=True))


def test_language_odd(odd, none):
    assert crf_langid.identify(none).count() == 0
    got = {r["row"]["doc_id"]: r["lang_pred"] for r in crf_langid.identify(odd).collect()}
    assert got[1] == got[2] == got[3] == "und"


# -- personal data ---------------------------------------------------------------------------------------------------


def plain_pii(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans)


def test_pii_base_is_exact():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("ab1.@-+_ 5()é") for _ in range(rng.randrange(40)))
        assert pii_segments.base_spans(text) == plain_pii(text), text
    assert pii_segments.base_spans("4111 1111 1111 1111") == [(0, 2, 19)]


def test_pii_field_adds(spark):
    model = pii_segments.fit([], pii_segments.PiiSpec())
    found = lambda t: [(pii_segments.KINDS[k], t[a:b]) for a, k, b in pii_segments.added_spans(t, pii_segments.base_spans(t), model, pii_segments.PiiSpec())]
    assert found("call (743) 555-3824 now") == [("phone", "(743) 555-3824")]
    assert found("write john.doe [at] mail dot example dot com please") == [("email", "john.doe [at] mail dot example dot com")]
    for clean in ("on 2024-01-02 we sold 1234567 for 12.50", "version 1.2.3.4567", "id 1234567890123456 ok", "isbn 978-3-16-148410-0", "from 1999-2003 on"):
        assert found(clean) == []


def test_pii_signs_without_at_sign():
    """Each spelling in a text without another "@": the look ahead lets all matches through, and the field adds them."""
    spec = pii_segments.PiiSpec()
    model = pii_segments.fit([], spec)
    found = lambda t: [t[a:b] for a, _, b in pii_segments.added_spans(t, pii_segments.base_spans(t), model, spec)]
    for address in ("info at example.com", "jo [AT] example [DOT] com", "jo AT example DOT com", "jo {at} example {dot} org", "jo ( at ) example.com"):
        assert found(f"write {address} please") == [address]
    for clean in ("they met at noon. It was late", "we meet at home. In the end", "look at it. Be kind"):
        assert found(clean) == []
    rng = random.Random(14)
    parts = ["jo", "a.b", "x" * 70, " dot ", " at ", " AT ", "(at)", "[ at ]", "{at}", "[@]", "@", " ", ".", "[dot]", "(", "]", "-", "com"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert list(pii_segments.written(text)) == [m.span() for m in pii_segments.WRITTEN.finditer(text)], text


def test_pii_long_written_forms():
    """Addresses of more than max_tokens tokens are candidates as wholes."""
    spec = pii_segments.PiiSpec()
    model = pii_segments.fit([], spec)
    for address in ("jane.doe [at] mail [dot] example [dot] com", "jane dot m dot doe at mail dot sub dot web dot example dot com", "a.b-c.d.e.f+g (at) mail (dot) sub (dot) example (dot) com"):
        text = f"write {address} please"
        assert [text[a:b] for a, _, b in pii_segments.added_spans(text, [], model, spec)] == [address]
    text = "_" + "a." * 31 + "b [at] " + "x-" * 31 + "x [dot] com_"
    (region,) = pii_segments.regions(text, spec)
    assert (1, len(text) - 1) in {(region.tokens[i][0], region.tokens[j - 1][1]) for i, j, _, _ in region.candidates}


def test_pii_odd(odd, none):
    rows = {r["doc_id"]: r for r in pii_segments.find(odd).collect()}
    assert rows[1]["spans"] == "" and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii_segments.find(none).count() == 0


# -- quality ---------------------------------------------------------------------------------------------------------


def test_quality_counts(spark):
    rng = random.Random(6)
    texts = ["", None, "a b c a b c", "a b a b a b", "x\nx\n \nx", *["\n".join(prose(rng, rng.randrange(8)) for _ in range(rng.randrange(30))) + " $%" for _ in range(40)], *[" ".join(rng.choice("ab c d") for _ in range(rng.randrange(60))) for _ in range(40)]]
    docs = spark.createDataFrame([(i, t, str(i % 3)) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in host_quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        repeated = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_quality_hosts(spark):
    rng = random.Random(7)
    noisy = lambda: " ".join(w + "###" for w in prose(rng, 80).split())
    rows = [(i, noisy() if i % 10 else prose(rng, 80), "bad") for i in range(40)] + [(100 + i, prose(rng, 80), f"good{i % 5}") for i in range(60)] + [(200, noisy(), "good1")]
    got = {r["doc_id"]: r for r in host_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["host_verdict"] == "suspect" and not got[1]["kept"] and got[0]["kept"]
    assert got[200]["host_verdict"] == "trusted" and got[200]["kept"]


def test_quality_odd(odd, none):
    assert host_quality.judge(odd).count() == odd.count()
    assert host_quality.judge(none).count() == 0


# -- html ------------------------------------------------------------------------------------------------------------


def test_html_text():
    page = '<html><head><title>no</title><style>p{}</style></head><body><header>top</header><nav><a href="/">Home</a></nav><article><header><h1>A &amp; B</h1></header><script>var t="</p>";</script><p>one  <b>two</b><br>three<p>four &lt; five<div class="comments"><p>nice</div><aside>ad</aside></article><form>x</form><footer>f</footer>'
    assert html_template.main_text(page, set(), set()) == "A & B\none two three\nfour < five"
    assert html_template.main_text(None, set(), set()) == html_template.main_text("", set(), set()) == ""
    assert html_template.main_text("plain &am", set(), set()) == "plain &am"


def test_html_template(spark):
    rng = random.Random(8)
    body = [prose(rng, 20) for _ in range(30)]
    rows = [(i, f"http://x.org/{i}", f'<body><div id="top"><a>Home</a> <a>{i} News</a></div><div class="stuff"><p>Welcome to our site</p><div id="text"><p>{body[i]}</p></div></div>') for i in range(30)]
    rows += [(100, None, None), (101, "no scheme", "")]
    got = {r["page_id"]: r for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert all(got[i]["text"] == html.unescape(body[i]) for i in range(30))
    assert got[100]["text"] == got[101]["text"] == "" and got[100]["n_chars"] == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_template.extract(empty).count() == 0


def test_html_template_inside_articles(spark):
    """Marks of the article don't decide: fixed texts and link lists in it go, slots of the template beside it stay."""
    rng = random.Random(13)
    body = [prose(rng, 20) for _ in range(20)]
    links = lambda: "".join(f'<li><a href="/">{prose(rng, 2)}</a>' for _ in range(rng.randrange(2, 6)))
    rows = [(i, f"http://x.org/{i}", f'<body><div class="intro">lead {body[i]}</div><main><h1>Title {i}</h1><p>Read this first</p><div class="text"><p>{body[i]}</p><p>{"half of them say so" if i < 12 else body[i][::-1]}</p></div><ul>{links()}</ul></main><div class="rare{"x" * i}">out</div></body>') for i in range(20)]
    # copies of a page are no template, nor are few pages
    rows += [(100 + i, "http://y.org/", f"<body><main><p>{body[0] if i < 8 else body[i]}</p></main></body>") for i in range(12)]
    rows += [(200 + i, "http://z.org/", f"<body><p>beside</p><main><p>few {i % 2}</p></main></body>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert got[i] == f"lead {body[i]}\nTitle {i}\n{body[i]}\n" + ("half of them say so" if i < 12 else body[i][::-1])
    assert [got[100 + i] for i in range(12)] == [body[0]] * 8 + body[8:12]
    assert [got[200 + i] for i in range(4)] == ["few 0", "few 1"] * 2


# -- lines -----------------------------------------------------------------------------------------------------------


def test_line_spread(spark):
    rows = [(i, f"own line {i}\nShared  Line\n\nfew sites" if i < 4 else f"own line {i}\nshared line", f"s{i}") for i in range(14)]
    rows += [(20, "shared line", "s1"), (21, None, "s1"), (22, "", None), (23, "shared line\nown 23", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit("x"))
    got = {r["doc_id"]: r for r in line_spread.remove_boilerplate(docs).collect()}
    assert got[0]["text"] == "own line 0\nShared  Line\n\nfew sites"  # the first keeps it
    assert got[1]["text"] == "own line 1\n\nfew sites" and got[1]["_n_removed"] == 1
    assert got[13]["text"] == "own line 13" and 20 not in got and got[21]["text"] is None and got[22]["text"] == ""


def test_line_spread_odd(odd, none):
    assert line_spread.remove_boilerplate(odd).count() == odd.count()
    assert line_spread.remove_boilerplate(none).count() == 0


# -- secrets ---------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def test_secrets(spark):
    rng = random.Random(9)
    parts = ["token", "Password", "secret", " = ", ": ", '"', "abcdefghij", "0" * 31, "f" * 33, "AKIA", "ABCDEFGHIJKL0", " ", "é", "api_key", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(300)] + [None, ""]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(plain_secrets(t or "").encode()).hexdigest(), t


def test_secret_battery(spark):
    rng = random.Random(10)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "key " + "".join(rng.choice(letters) for _ in range(40)) + " end") for i in range(20)] + [(100 + i, f"see this_is_a_very_long_function_name_number_{i} and aaaaaaaaaaaaaaaaaaaaaaaaaaaa1 here") for i in range(20)]
    got = {r["doc_id"]: r["n_random"] for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert sum(got[i] for i in range(20)) >= 18 and not any(got[100 + i] for i in range(20))


def test_secrets_odd(odd, none):
    assert secrets.digest(secrets.scan(odd)).count() == odd.count()
    assert secrets.digest(secrets.scan(none)).count() == 0


# -- near duplicates -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([3, 12, 40, 120])) for _ in range(60)]
    for _ in range(140):
        w = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = "Z" + str(rng.randrange(99))
        texts.append(" ".join(w))
    texts += ["", None, "one", "One", "one two", " one\ttwo "]
    rows = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    rules = near_dedup.NearDupRules(width=width)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(rows, rules).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root(i), root(i) == i)


def test_near_duplicates_open_pairs(spark):
    """A chain in which most pairs are below the threshold: hubs alone don't connect it, nor do centres."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 100])) for i in range(20)]
    for rules in (near_dedup.NearDupRules(width=2), near_dedup.NearDupRules(width=2, first_bands=1)):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rules).collect()
        assert {r["component_id"] for r in got} == {0}


def test_near_duplicates_of_few_words(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(rows, near_dedup.NearDupRules(width=1)).collect()}
    sets, parent = [set(t.split()) for t in texts], list(range(300))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in range(300):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {i: root(i) for i in range(300)}


def test_small_sets_share_exact_keys():
    """All links of sets of up to ten at 80 percent, among them a set of eight inside one of ten."""
    import numpy as np

    sets = {n: np.random.default_rng(n).integers(1, 1 << 63, n).astype(np.uint64) for n in range(1, 11)}
    for n, members in sets.items():
        for gone in range(1, n):
            if 100 * (n - gone) >= 80 * n:
                assert set(near_dedup.small_keys(members)) & set(near_dedup.small_keys(members[gone:])), (n, gone)
                assert set(near_dedup.small_keys(members)) & set(near_dedup.small_keys(members[:-gone])), (n, gone)
    assert len(near_dedup.small_keys(sets[9])) == 10 and len(near_dedup.small_keys(sets[10])) == 56


def test_near_duplicates_odd(odd, none):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(odd).collect()}
    assert got[5]["component_id"] == got[6]["component_id"] == got[10]["component_id"] == 4 and got[None]["kept"] and got[1]["n_shingles"] == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert sorted(str(r["doc_id"]) for r in near_dedup.one_of_each(odd).collect()) == sorted(map(str, [None, 1, 2, 3, 4, 7, 8, 9]))
