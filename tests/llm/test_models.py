"""Operators 3, 4, 5, 6 and 9, and the pipeline, on small fixtures."""

import math
import random
import re

import numpy as np

import corpus_pipeline
from tidegauge.llm import language_id, pii, quality, topk, urls

LATIN = {"aa": "kato lumi sanoo että metsä on syvä ja hiljainen yöllä", "bb": "the river runs down from the hill into a wide green field", "cc": "der wald ist tief und der fluss läuft schnell über die steine"}


def test_language_id(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.sample(LATIN[x].split(), 6)), x, "clash") for k, x in enumerate("aa bb cc".split() * 40)]
    odd = [(900, None, "aa", ""), (901, "", None, ""), (902, "12 ?! 34", "bb", ""), (None, "the river", None, ""), (903, "the river", "bb", ""), (903, "the river", "bb", "")]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, score string")
    train, test = df.filter("doc_id div 3 % 3 <> 1"), df
    model = language_id.train_language_model(train)
    got = language_id.predict_languages(test, model).collect()
    assert len(got) == len(rows) + len(odd)
    held = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 900 and x["doc_id"] // 3 % 3 == 1]
    assert np.mean([x["lang_pred"] == x["lang"] for x in held]) > 0.95
    by = {x["doc_id"]: x for x in got}
    assert all((by[k]["lang_pred"], by[k]["lang_score"]) == ("und", 0.0) for k in (900, 901, 902)) and by[None]["lang_pred"] == "bb"
    assert language_id.train_language_model(df.limit(0)).predict(["text"])[0] == ["und"]
    assert language_id.predict_languages(df.limit(0), model).count() == 0


def test_language_scores_are_plain_naive_bayes(spark):
    """Against a table of n-grams counted and scored one by one."""
    from collections import Counter

    r = random.Random(5)
    rows = [(k, " ".join(r.sample(LATIN[x].split(), 5)).title() + ", 12", x) for k, x in enumerate("aa bb cc".split() * 30)]
    model = language_id.train_language_model(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))

    names = {}
    for _, text, _ in rows:
        hashed, _, _ = language_id.grams([text])
        for k in range(len(text)):
            for n, h in enumerate(hashed, 1):
                own = ("".join(c if c.isalpha() else " " for c in text.lower()) + "   ")[k:k + n]
                if own.strip():
                    assert names.setdefault((n, own), int(h[k])) == int(h[k])
    counts, documents = {x: Counter() for x in LATIN}, Counter(x for _, _, x in rows)
    for _, text, x in rows:
        shown = "".join(c if c.isalpha() else " " for c in text.lower()) + "   "
        counts[x].update(names[n, shown[k:k + n]] for k in range(len(text)) for n in (1, 2, 3) if shown[k:k + n].strip())
    buckets = 1 << language_id.BUCKET_BITS
    for _, text, _ in rows[:20]:
        shown = "".join(c if c.isalpha() else " " for c in text.lower()) + "   "
        own = [names[n, shown[k:k + n]] for k in range(len(text)) for n in (1, 2, 3) if shown[k:k + n].strip()]
        want = [
            math.log((documents[x] + 1) / (len(rows) + 3)) + sum(math.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * buckets)) for b in own) for x in sorted(LATIN)
        ]
        got, _ = model.scores([text])
        assert np.allclose(got[0], want, rtol=1e-5)


def test_any_number_of_languages(spark):
    rows = [(k, f"{chr(0x4e00 + k)} {chr(0x4e00 + k)}{chr(0x5e00 + k)}", f"l{k:04d}") for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train_language_model(df)
    got = language_id.predict_languages(df.withColumn("own_0", df["lang"]), model, names=("own_1", "own_2")).collect()
    assert len(model.languages) == 700 and np.mean([x["own_1"] == x["own_0"] for x in got]) > 0.95


def test_risk_and_its_gradient():
    """The risk against its definition, its step against differences of it, and the clamp."""
    r = np.random.default_rng(4)
    clamped = 0
    for prior in (0.2, 0.5, 0.97):
        at_p, at_u = r.integers(0, 3 if prior > 0.9 else 6, (9, 3)), r.integers(3 if prior > 0.9 else 0, 6, (14, 3))
        w, b = r.normal(size=6) + np.repeat([1, -1], 3) * (prior > 0.9), 0.3
        score = lambda at, w, b: 1 / (1 + np.exp(-(w[at].sum(axis=1) + b)))
        loss = lambda s, y: -np.log(s if y else 1 - s)
        negative = lambda w, b: loss(score(at_u, w, b), 0).mean() - prior * loss(score(at_p, w, b), 0).mean()
        plain = lambda w, b: prior * loss(score(at_p, w, b), 1).mean() + negative(w, b)
        value, step = quality.risk(at_p, at_u, prior, w, b)
        below = negative(w, b) < 0
        clamped += below
        assert abs(value - (plain(w, b) if not below else plain(w, b) - negative(w, b))) < 1e-6
        of = (lambda w, b: -negative(w, b)) if below else plain
        slopes = [(of(w + d[:-1], b + d[-1]) - of(w - d[:-1], b - d[-1])) / 2e-5 for d in np.eye(7) * 1e-5]
        assert np.allclose(step, slopes, atol=1e-6)
    assert 0 < clamped < 3


def test_estimated_prior():
    r = np.random.default_rng(8)
    for share in (0.2, 0.5, 0.8):
        good, mixed = r.beta(8, 2, 4000), np.where(r.random(8000) < share, r.beta(8, 2, 8000), r.beta(2, 8, 8000))
        assert abs(quality.estimated_prior(good, mixed) - share) < 0.08


def test_quality(spark):
    r = random.Random(2)
    words = LATIN["bb"].split()
    good = lambda: ". ".join(" ".join(r.choice(words) for _ in range(12)).capitalize() for _ in range(8)) + "."
    bad = lambda: r.choice([" ".join([r.choice(words)] * 90), good().upper().replace(" ", "!! "), good().replace(" ", "### ")])
    rows = [(k, bad() if k % 6 == 0 else good(), "clash") for k in range(900)]
    df = spark.createDataFrame([*rows, (2000, None, ""), (2001, "", ""), (None, "x", ""), (5, rows[5][1], "")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 6 != 0), 0) for k in range(0, 900, 1) if k % 7 < 4] + [(None, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train_quality_model(df.filter("doc_id % 4 <> 2"), labels.filter("doc_id % 4 <> 2"))
    got = quality.score_quality(df, model).collect()
    held = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 900 and x["doc_id"] % 4 == 2]
    assert np.mean([x["predicted"] == int(x["doc_id"] % 6 != 0) for x in held]) > 0.93
    assert len(got) == 904 and all(0 <= x["score"] <= 1 and not math.isnan(x["score"]) for x in got)
    empty = quality.train_quality_model(df.limit(0), labels.limit(0))
    assert quality.score_quality(df.limit(0), model).count() == 0 and 0 < empty.scores(np.zeros((1, len(quality.FEATURES))))[0] < 1


def test_urls(spark):
    link = lambda u: f'<link href="{u}" rel=canonical>'
    data = [
        (1, "http://a.com/en/1", None, ""), (2, "https://EXAMPLE.com/en/7x?q", "", ""), (3, "x.example.net", "", ""), (4, None, None, None), (5, "h://www.Example.net/de/8#f", "", ""), (6, "h://notexample.net/de/9", "", ""), (7, "h://b.org/es/", "", ""), (8, "h://b.org?x=/es/", "", ""),
        (10, "h://alias.io/1", link("http://a.com/en/1"), ""), (11, "h://alias.io/2", '<meta content="0; url=/1" http-equiv="refresh">', ""), (12, "h://other.io/", link("h://clean.io/"), ""),
        (13, "h://mixed.io/x", link("http://a.com/en/2"), ""), (14, "h://mixed.io/y", link("h://mixed.io/x"), ""), (15, "https://example.com/en/71", link("h://mixed.io/y"), ""), (16, "h://chain.io/1#frag", link("2"), ""), (17, "h://chain.io/2", link("//b.org/es/9"), ""), (17, "h://chain.io/2", "", ""),
    ]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string, verdict string")
    got = {(x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in urls.judge_urls(df).collect()}
    assert got == {
        (1, "a.com", "/en/1", "com/en/", "block"), (2, "example.com", "/en/7x", "example.com/en/7", "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "www.example.net", "/de/8", "example.net/de/8", "block"), (6, "notexample.net", "/de/9", "net/de/", "allow"), (7, "b.org", "/es/", "org/es/", "block"), (8, "b.org", "", None, "allow"),
        (10, "alias.io", "/1", None, "block"), (11, "alias.io", "/2", None, "block"), (12, "other.io", "/", None, "allow"), (13, "mixed.io", "/x", None, "allow"), (14, "mixed.io", "/y", None, "allow"), (15, "example.com", "/en/71", "example.com/en/7", "allow"), (16, "chain.io", "/1", None, "block"), (17, "chain.io", "/2", None, "block"),
    }
    assert urls.judge_urls(df).count() == len(data) and urls.judge_urls(df.limit(0)).count() == 0
    redirects = spark.createDataFrame([("h://clean.io/", "h://b.org/es/2")], "a string, b string")
    assert {x["page_id"]: x["verdict"] for x in urls.judge_urls(df, redirects=redirects).collect()}[12] == "block"


def test_urls_agree_with_their_sql(spark):
    """Chains, cycles, several links on a page, links that don't count, an allow among blocks."""
    import duckdb

    link = lambda *us: "<html>" + "".join(f'<link rel="canonical" href="{u}">' for u in us)
    pages = [(1, "h://a.com/en/1", None), (2, "h://c1.io/1", link("h://c1.io/2")), (3, "h://c1.io/2", link("h://c1.io/3")), (4, "h://c1.io/3", link("h://a.com/en/1")), (5, "h://r.io/a", link("/b", "h://b.org/es/9")), (6, "h://r.io/b", None), (7, "h://cy.io/1", link("h://cy.io/2")), (8, "h://cy.io/2", link("h://cy.io/3")), (9, "h://cy.io/3", '<META content="0; URL=h://cy.io/1" http-equiv=refresh>'), (10, "h://cy.io/4", link("h://cy.io/1", "h://x.org/es/")), (11, "h://ok.io/1", link("https://example.com/en/7z", "h://y.org/es/2")), (12, "h://ok.io/2", link("h://ok.io/1")), (13, "h://hid.io/", "<!-- " + link("h://a.com/en/1") + " --><script>'" + link("h://a.com/en/1") + "'</script>"), (14, "h://two.io/?a=1&b=2", link("h://z.org/es/?a=1&amp;b=2")), (15, "h://two.io/x", link("h://two.io/?a=1&amp;b=2")), (16, None, link("h://a.com/en/1")), (17, "no scheme", link("h://a.com/en/1")), (18, "h://r.io/b", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    got = sorted(tuple(x) for x in urls.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect())
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    assert got == sorted(con.execute(f"select page_id, host, path, rule, verdict from ({urls.OP5_SQL})").fetchall())
    verdicts = {x[0]: x[4] for x in got}
    assert [verdicts[k] for k in (2, 3, 4, 5, 6, 7, 8, 9, 10)] == ["block"] * 9 and [verdicts[k] for k in (11, 12, 13, 16, 17)] == ["allow"] * 5 and verdicts[14] == verdicts[15] == "block"


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    r = random.Random(6)
    parts = ["a", "b.c", "@", "@x", "mail.de", "1.2.3.4", "5", "255", ".", "..", "-", " ", "+", "+1 ", "(650)", "4111111111111111", "4111 1111-1111 1111", "é", "%", "_", "\n", "012", "999.1.1.1.2.3.4.5.6"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert pii.base_spans(text) == plain_base(text), text


def test_pii(spark):
    data = [(1, "mail me.x@ab.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111 at 10.0.0.1.", ""), (2, None, ""), (3, "", ""), (4, "please call (212) 555-0147 today. write to jo.doe (at) example (dot) com soon", ""), (5, "In 2021 we sold 123456 units of version 3.0 at 10:30.", ""), (5, "x " * 30000, ""), (None, "call (212) 555-0147 now", "")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, spans string")
    got = [(x["doc_id"], [(s["kind"], s["base"]) for s in x["spans"]]) for x in pii.find_pii(df).collect()]
    assert ("email", True) in got[0][1] and ("phone", True) in got[0][1] and ("card", True) in got[0][1] and ("ip", True) in got[0][1] and len(got[0][1]) == 4
    assert [x[1] for x in got[1:]] == [[], [], [("phone", False), ("email", False)], [], [], [("phone", False)]]
    red = [x["text"] for x in pii.redact(df).collect()]
    assert red[0] == "mail [EMAIL] or [PHONE], card [CARD] at [IP]." and red[1] is None and red[4] == data[4][1]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_field_on_held_out_sentences():
    model = pii.default_model()
    right = total = 0
    import pyarrow as pa

    for words, labels in pii.labelled_table(copies=2, seed=99):
        masks, _ = pii.attributes(pa.array(words))
        got = model.decode(masks, np.array([len(words)]))
        right += int((got == np.array(labels)).sum())
        total += len(words)
    assert right / total > 0.97


def test_viterbi_and_partition_by_enumeration():
    import itertools

    import pyarrow as pa

    model = pii.default_model()
    sentences = ["call (212) 555-0147 now", "mail jo (at) x.org please", "ip 10.0.0.1:80", "4111 1111 1111 1111", "a", "no data 12 here"]
    every = [w for s in sentences for w in s.split()]
    masks, _ = pii.attributes(pa.array(every))
    lengths = np.array([len(s.split()) for s in sentences])
    got, at = model.decode(masks, lengths), 0
    for n in lengths:
        own = masks[at:at + n]
        scores = model.scores(own, np.zeros(n, int))
        weight = lambda y: model.start[y[0]] + sum(scores[k, y[k]] for k in range(n)) + sum(model.step[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        paths = list(itertools.product(range(len(pii.KINDS) + 1), repeat=int(n)))
        weights = np.array([weight(y) for y in paths])
        assert tuple(got[at:at + n]) == paths[int(weights.argmax())]
        assert abs(model.log_partition(own) - float(pii.log_sum(weights, 0))) < 1e-8
        at += n


#: Sentences written by hand, in no template's words: (text, spans as they stand).
BY_HAND = [
    ("You can reach our night desk under (415) 555-0132 until six.", ["(415) 555-0132"]), ("Fragen bitte an 030-555-0199 richten.", ["030-555-0199"]), ("Her assistant picks up at 212-555-0188 most days.", ["212-555-0188"]),
    ("Send the draft to anna.berg (at) example (dot) org before Friday.", ["anna.berg (at) example (dot) org"]), ("The old gateway sat on 192.168.4.20:8080 for years.", []), ("He scored 34 points in 1998 and 41 in 1999.", []),
    ("Chapter 12 starts on page 345.", []), ("The bill came to 1,204.50 in the end.", []), ("Version 2.4.1 fixed it on 12/05/2021.", []), ("They met at noon at the station.", []), ("Look at example 3 in the text.", []), ("Try 555-0143 if nobody answers.", ["555-0143"]),
]


def test_added_spans_on_sentences_by_hand():
    import pyarrow as pa

    texts = [t for t, _ in BY_HAND]
    found = [[t[a:b] for a, k, b in every if (a, k, b) not in base] for t, (base, every) in zip(texts, pii.all_spans(pa.array(texts), pii.default_model()))]
    right = sum(x in want for (_, want), got in zip(BY_HAND, found) for x in got)
    print("added spans by hand: precision", right, "of", sum(map(len, found)), "recall of", sum(len(w) for _, w in BY_HAND), found)
    assert right >= 0.6 * sum(len(w) for _, w in BY_HAND) and right >= 0.8 * sum(map(len, found))


def test_long_sentences_and_odd_white_space():
    import pyarrow as pa

    model = pii.default_model()
    texts = ["word " * n + "please call (212) 555-0147 today" + " word" * 100 for n in range(55, 70)] + ["please\x1ccall (212) 555-0147 now", "a\u00a0b\x85 please call (212) 555-0147 today"]
    for text, (_, every) in zip(texts, pii.all_spans(pa.array(texts), model)):
        assert [text[a:b] for a, _, b in every] == ["(212) 555-0147"], text


def test_exact_top_k(spark, monkeypatch):
    r = np.random.default_rng(3)
    vectors = [(k, [float(x) for x in r.integers(-3, 4, 6) / 8]) for k in range(300)] + [(400, None), (401, [1.0, None] + [0.0] * 4), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [1.0, 2.0]), (405, []), (None, [9.0] * 6), (50, [-9.0] * 6), (500, [1e9] * 6), (-50, [0.5] * 6)]
    df = spark.createDataFrame([(k, v, "x") for k, v in vectors], "vec_id bigint, embedding array<double>, score string")
    monkeypatch.setattr(topk, "SHARD_ROWS", 16)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    got = topk.exact_top_k(df, df.filter("vec_id % 50 = 0")).collect()
    clean = {}
    for k, v in vectors:
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(256 * x) for x in v]
            clean[k] = min(clean.get(k, ints), ints)
    for q in [k for k in clean if k % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(clean[q], v)), k) for k, v in clean.items() if k != q and len(v) == len(clean[q]))[:5]
        assert [(x["rank"], x["vec_id"], x["score"]) for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == [(n, k, -s) for n, (s, k) in enumerate(best, 1)]
    assert topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    r = random.Random(7)
    row = lambda k, t, lang: (k, t, lang, "s", len(t) if t is not None else None)
    text = lambda x: " ".join(r.choice(LATIN[x].split()) for _ in range(60))
    docs = [row(k, text(x), x) for k, x in enumerate("aa bb cc".split() * 12)]
    docs += [row(100, "  " + docs[1][1], "bb"), row(101, docs[2][1] + " extra", "cc"), row(102, None, None), row(103, "123 456", "aa"), row(104, "contact me.x@ab.example.com please about the river and the hill", "bb")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == df.columns, name
    got = {x["doc_id"]: x["text"] for x in kept.collect()}
    assert set(got) == {*range(36), 100, 104} - {1} and got[104].startswith("contact [EMAIL] please")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == set(got)
    odd = df.unionByName(df.limit(3)).selectExpr("*", "lang as lang_pred", "1.5 as lang_score", "text as __text", "doc_id as __row", "n_chars as x_id", "'k' as x_kept", "'z' as own_0", "2 as comp").repartition(3)
    odd = odd.unionByName(odd.limit(1).selectExpr("cast(200 as bigint) doc_id", "concat(repeat('the river runs down ', 6000), text) text", "'bb' lang", "source", "n_chars", "lang_pred", "lang_score", "__text", "__row", "x_id", "x_kept", "own_0", "comp"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, "")
    assert odd.columns[5:] == ["lang_pred", "lang_score", "__text", "__row", "x_id", "x_kept", "own_0", "comp"]
    rows = odd.collect()
    assert {x["doc_id"] for x in rows} == {*got, 200} and len(rows) == len(got) + 1 and all(x["x_kept"] == "k" and x["own_0"] == "z" and x["__row"] == x["doc_id"] for x in rows if x["doc_id"] != 200)
    assert corpus_pipeline.run(spark, str(_empty(spark, df, tmp_path))).count() == 0


def _empty(spark, df, tmp_path):
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    return tmp_path / "none"
