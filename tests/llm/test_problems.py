import json
import os
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import canonical, encoding, leakage, near_duplicates, privacy, queries, splitting, top_items, truncation
from signalloom.llm.bpe import Encoder, merge, ranks_of
from signalloom.llm.setsketch import Family, band_keys, joint_similarity

from .. import oracle

WORD = re.compile(r"[^\W_]+")
NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def texts(n, seed, words=60):
    r = random.Random(seed)
    return [" ".join(f"{r.choice(NAMES)}{r.randrange(40)}" for _ in range(words)) for _ in range(n)]


# 1


def test_hazards_find_the_limit(spark):
    r = random.Random(0)
    lengths = [min(200, int(r.expovariate(1 / 120)) + 5) for _ in range(6000)] + [3] * 2
    rows = {}
    for x in lengths:
        rows[x] = rows.get(x, 0) + 1
    df = spark.createDataFrame([("s", "body", k, v) for k, v in rows.items()], "source string, field_name string, length int, n long")
    out = truncation.hazards(df).collect()
    assert [x.length for x in out if x.significant] == [200]
    at_risk = {x.length: x.at_risk for x in out}
    assert at_risk[200] == rows[200] and at_risk[3] == len(lengths)
    assert all(abs(x.hazard - x.n / x.at_risk) < 1e-12 for x in out)
    assert truncation.hazards(df.limit(0)).count() == 0


def test_binomial_tail():
    assert truncation.binomial_tail(0, 10, 0.1) == 1.0
    assert abs(truncation.binomial_tail(2, 2, 0.1) - 0.01) < 1e-12
    assert truncation.binomial_tail(500, 500, 0.5) < 1e-100


def test_truncated_texts(spark):
    r = random.Random(1)
    whole = [f"The team must export {r.choice(NAMES)} reports because the {r.choice(NAMES)} import has no preview. We lost {r.randrange(90)} tickets every single morning." for _ in range(400)]
    rows = [(i, "a", t, "Summary of it.") for i, t in enumerate(whole)]
    odd = {1000: "The team must export alpha reports because the beta imp", 1001: "We lost 9 tickets every single … Read more", 1002: "All fine. See [the export lo", 1003: "All good.\n```\nrow 17",
           1004: "The team must export gamma reports because the", 1005: "We lost 5 tickets every single morning, &nbs"}
    fine = {2000: "We lost 7 tickets every single morning", 2001: "[deleted]", 2002: None, 2003: "", 2004: "  ", 2005: "The team must export eta reports because the beta import has no preview. 🙏", 2006: "Done.\n```\nok\n```", 2007: "Curious what others do (yes, really)"}
    rows += [(k, "a", v, None) for k, v in (odd | fine).items()]
    df = spark.createDataFrame(rows, "id long, source string, body string, summary string").withColumns({"text": F.lit(1), "length": F.lit("x")})
    t = truncation.Truncation(df)
    assert {(x.id, x.field_name) for x in t.values().collect()} == {(k, "body") for k in odd}
    report = {x.field_name: (x.n_values, x.n_truncated) for x in t.report().collect()}
    assert report == {"body": (400 + len(odd) + len(fine) - 1, len(odd)), "summary": (400, 0)}
    assert truncation.Truncation(df.limit(0)).values().count() == 0


def test_ends_are_learnt_from_all_values(spark):
    # four sentences of each kind among 20,000 values; a sample of a third seldom holds three of them
    kinds = [f"{a}o" for a in NAMES[:12]]
    texts = [f"All is fine here with {NAMES[i % 24]}." for i in range(20000)] + [f"A {k} grows near {k}rn every night." for k in kinds for _ in range(4)]
    rows = [(i, "a", t, None) for i, t in enumerate(texts)] + [(90000 + i, "a", f"A {k} grows near {k}rn", None) for i, k in enumerate(kinds)]
    # a cut that three values share goes on all the same, but words that end texts don't
    rows += [(91000 + i, "a", t, None) for i, t in enumerate([f"A {NAMES[13]} workar" for _ in range(3)] + [f"My workaround is {NAMES[i % 24]}." for i in range(400)] + ["Thanks to everybody"] * 5)]
    df = spark.createDataFrame(rows, "id long, source string, body string, summary string")
    assert {x.id for x in truncation.Truncation(df).values().collect()} == {90000 + i for i in range(12)} | {91000, 91001, 91002}


def test_counts_of_ends():
    r = random.Random(5)
    texts = [" ".join(r.choice(["we", "lost it.", "all", "3", "fine!\n", "Ok…", "it's"]) for _ in range(r.randrange(1, 30))) for _ in range(300)]
    want, words = {}, {}
    for s, whole in (x for t in texts for x in truncation.sentences(t)):
        for i in range(len(s)):
            end = i == len(s) - 1
            if i:
                w = words.setdefault(s[i], [0, 0])
                w[end and not whole] += 1
            for n in range(1, min(truncation.ORDER, i + 1) + 1):
                if whole or not end or n == len(s):
                    k = want.setdefault(truncation.contexts(s[i - n + 1 : i + 1])[-1], [0, 0])
                    k[0] += 1
                    k[1] += end
    counts = truncation.Counts(np.full(1 << 17, 255, np.uint8), 20)
    counts.add(texts[:100])
    counts.add(texts[100:])
    got = counts.taken().to_pylist()
    assert {x["key"]: [x["n"], x["ended"]] for x in got if x["word"] is None} == want
    assert {x["word"]: [x["n"], x["ended"]] for x in got if x["key"] is None} == words
    assert counts.taken().num_rows == 0


def test_marks_of_loss_that_end_like_whole_texts(spark):
    lost = ["We lost it (...)", "We lost it (…)", "We lost it (cont.)", "This is **bold text without an end.", "See [the log](http://example.org/a/very/long/path/with/many/parts/and/so/on/until/it.", "See <a title='very long title that goes on for more than the last forty-eight characters.", "Steps:\n1. Open it.\n2."]
    whole = ["We lost it (yes.)", "This is **bold** text.", "See [the log](http://example.org/a.b).", "One.\nTwo.", "Version 2."]
    df = spark.createDataFrame([(i, "a", t, None) for i, t in enumerate(lost + whole)], "id long, source string, body string, summary string")
    assert {x.id for x in truncation.Truncation(df).values().collect()} == set(range(len(lost)))


def test_ends_are_learnt_without_ids(spark):
    rows = [(None, "a", f"The team must export {NAMES[i % 24]} reports every day.", None) for i in range(48100)] + [(None, "a", "The team must export alpha reports every", None)]
    df = spark.createDataFrame(rows, "id long, source string, body string, summary string")
    assert [(x.id, x.field_name) for x in truncation.Truncation(df).values().collect()] == [(None, "body")]


# 2


@pytest.mark.parametrize("bands", [1, 4])
def test_top_items(spark, bands):
    r = random.Random(bands)
    rows = [(r.choice(["hot", "hot", f"g{r.randrange(30)}", "", None]), r.choice([None, 1.0, 2.0, 3.0, float(r.randrange(9))]), i, "x") for i in range(900)]
    df = spark.createDataFrame(rows + rows[:5], "g string, s double, i long, band string")
    got = sorted((x.g, x.rank_no, x.i) for x in top_items.top_per_group(df, "g", "s", "i", 3, bands=bands).collect())
    want = []
    for g in {x[0] for x in rows if x[0]}:
        best = sorted((x for x in rows + rows[:5] if x[0] == g and x[1] is not None), key=lambda x: (-x[1], x[2]))[:3]
        want += [(g, k + 1, x[2]) for k, x in enumerate(best)]
    assert got == sorted(want)
    assert top_items.top_per_group(df.limit(0), "g", "s", "i").count() == 0


def test_top_items_of_a_hot_group(spark, monkeypatch):
    # nine tenths of the rows in one group, most of one score, and filled groups that aren't sent to all tasks
    monkeypatch.setattr(top_items, "SMALL_SIDE", 0)
    df = spark.range(20000).selectExpr("if(id % 10 = 0, concat('g', id % 700), 'hot') g", "if(id % 3 = 0, double(id % 50), 7.5D) s", "id i")
    rows = [tuple(x) for x in df.collect()]
    want = set()
    for g in {x[0] for x in rows}:
        want |= {(g, k + 1, x[2]) for k, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))[:3])}
    assert {tuple(x) for x in top_items.top_per_group(df, "g", "s", "i", 3, bands=5).collect()} == want
    odd = spark.sql("select 'a' g, double('NaN') s, 5L i union all select 'a', 1e300D, 4L union all select 'a', double('Infinity'), 1L union all select 'a', 2D, 2L")
    assert sorted((x.rank_no, x.i) for x in top_items.top_per_group(odd, "g", "s", "i", 3, bands=3).collect()) == [(1, 5), (2, 1), (3, 4)]


# 3


def test_canonical_form():
    assert canonical.canonical("Ｆｕｌｌ  wi​dth TEXT ﬁne Café") == "full width text fine café"
    assert canonical.canonical("раyment") == canonical.canonical("Payment") == "payment"
    assert canonical.canonical("Ошибка") == "ошибка" and canonical.canonical(None) is None and canonical.canonical("") == ""
    assert "‍" in canonical.canonical("👩‍💻 ok")
    for _ in range(300):
        s = "".join(random.choice("aBéǺ​ ß　ｆŐΣςп𝐀İ🙂 \n") for _ in range(12))
        assert canonical.canonical(canonical.canonical(s)) == canonical.canonical(s)


def test_lookalikes_of_every_script():
    for odd in ("eхport", "expοrt", "expօrt", "expⲟrt", "Ꭼxport", "ꭼxport", "ꓰxport", "expჿrt", "expסrt", "expهrt", "expⵔrt"):
        assert canonical.deviates(odd) and canonical.canonical(odd) == "export", odd
    assert len("".join(canonical.MORE_LOOKALIKES)) == len(canonical.MORE_LOOKALIKES)
    for c in canonical.MORE_LOOKALIKES:
        s = canonical.canonical(f"ab{c}d")
        assert s.isascii() and canonical.canonical(s) == s, c


def test_the_form_is_stable():
    letters = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if canonical._other_script.match(c)]
    others = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]) if unicodedata.category(c)[0] in "MZ" or unicodedata.category(c) in ("Cf", "No", "Lm") or "！" <= c <= "～"]
    r = random.Random(6)
    texts = [x for c in letters + others for x in ("a" + c, c + "ß", c)] + ["Һn", "\u0345ß", "ｅ\u0301a"]
    texts += ["".join(r.choice(letters if r.random() < 0.5 else others if r.random() < 0.5 else "aBßnİ e") for _ in range(r.randrange(2, 6))) for _ in range(30000)]
    for x in texts:
        y = canonical.canonical(x)
        assert canonical.canonical(y) == y and canonical.unseen(y) == y, x
        assert not canonical.deviates(y) or canonical._mixed_words(y), x  # only letters that look like no Latin one


def test_kept_values_are_bounded(monkeypatch):
    monkeypatch.setattr(canonical, "KEPT_CHARS", 100)
    kept = canonical._Kept(str.lower)
    for i in range(50):
        assert kept[f"Value {i}"] == f"value {i}" and kept.chars <= 100
    assert kept["X" * 500] == "x" * 500 and "X" * 500 not in kept


def test_deviations():
    bad = ["ａbc", "Café", "a​b", "soft­hyphen", "no break", "thin space", "pаyment", "a‍ b"]
    good = [None, "", "plain", "Café – “quotes” … 🙏", "👩‍💻 👨‍👩‍👧 ❤️", "Ошибка сервера", "在庫不足", "the Ω release", "½ ² €"]
    assert [canonical.deviates(x) for x in bad] == [True] * len(bad)
    assert [canonical.deviates(x) for x in good] == [False] * len(good)
    assert canonical.deviates_json(json.dumps(["ok", "ａ"])) and not canonical.deviates_json('["\\uff41') and not canonical.deviates_json(None) and not canonical.deviates_json('{"a": "ａ"}')
    assert canonical.canonical_json('["A\\u00a0B", 3]') == '["a b", 3]' and canonical.canonical_json("{x") == "{x"


def test_canonical_rows(spark):
    df = spark.createDataFrame([(1, "Ａ", '["b"]', 5), (1, "Ａ", '["b"]', 5), (2, None, None, 5), (None, "x", "{", 5)], "id long, body string, evidence_spans_json string, t int")
    assert sorted((r.id or 0, r.body, r.evidence_spans_json) for r in canonical.canonical_rows(df).collect() if r.body) == [(0, "x", "{"), (1, "a", '["b"]'), (1, "a", '["b"]')]
    assert [(r.id, r.field_name) for r in canonical.deviating_values(df).collect()] == [(1, "body"), (1, "body")]
    assert canonical.deviating_values(df.limit(0)).count() == 0 and canonical.canonical_rows(df.limit(0)).count() == 0


# 4


def test_personal_information():
    cases = {
        "Mail ana.b+x@example.org or call 415-555-0199.": "Mail [EMAIL] or call [PHONE].",
        "write to jo (at) example [dot] com now": "write to [EMAIL] now",
        "reach jo at example dot com now": "reach [EMAIL] now",
        "call four one five five five five zero one nine nine today": "call [PHONE] today",
        "Ask Dr. Weber about SSN 912-18-6431": "Ask [PERSON_NAME] about SSN [ID_NUMBER]",
        "According to Maria Lopez, it went to 12 Oak Hill Rd, Apt 3B, Bellhaven": "According to [PERSON_NAME], it went to [STREET_ADDRESS]",
        "ＭＡＲＩＡ Lopez, tel. +44 20 7946 0443": "[PERSON_NAME], tel. [PHONE]",
        "Our shop is at PO Box 55, Ostermoor.": "Our shop is at [STREET_ADDRESS].",
        "passport no. X8995032; NI number QQ 35 19 84 D": "passport no. [ID_NUMBER]; NI number [ID_NUMBER]",
        "pаt@exаmple.org": "[EMAIL]",
    }
    for text, want in cases.items():
        assert privacy.redacted(text) == want, text
        assert privacy.redacted(want) == want
    kept = ["Install pkg@2.3.1, ticket 555-2024-0031, version 10.4.2.118", "Atlas Ledger and Orvane Systems", "The 24 Hour Street Team is a product", "4,155,550,123 rows on 2025-11-03 04:15:22", "See r/ops or u/ledger_otter", "", None, "café 👩‍💻"]
    for text in kept:
        assert privacy.detect(text) == [] and privacy.redacted(text) == text
    assert privacy.kinds("Lopez, Maria", "author") == ["person_name"] and privacy.kinds("ledger_fox", "author") == [] and privacy.kinds("M. Lopez (ops)", "author") == ["person_name"]


@pytest.mark.parametrize("disguised, kind", [
    ("five five five, one two three four", "[PHONE]"), ("jo (at) example [dot] com", "[EMAIL]"), ("jo at example dot com", "[EMAIL]"), ("jo&#64;example.org", "[EMAIL]"), ("ｊｏ＠example.org", "[EMAIL]"),
    ("j\u200bo@exam\u200bple.org", "[EMAIL]"), ("pаt@exаmple.org", "[EMAIL]"), ("415\u00a0555\u00a00199", "[PHONE]"), ("four one five five five five zero one nine nine", "[PHONE]"), ("９12-18-6431", "[ID_NUMBER]"),
])
def test_disguises_at_every_place(disguised, kind):
    other = "x\u200bx, "  # a change of its own before the disguise
    for before in ("", "mine is ", other):
        for after in ("", ".", " now", " \u200b end", " or five five five one two three four"):
            got = privacy.redacted(before + disguised + after)
            assert got == before + kind + after.replace("five five five one two three four", "[PHONE]"), (before, disguised, after)
            assert privacy.detect(got) == []


def test_offsets_lead_back_to_the_source():
    text = "x​x ｊｏ​（at）example.org y, four one five, five five five, zero one nine nine!"
    spans = [text[a:b] for a, b, _ in privacy.detect(text)]
    assert spans[-1] == "four one five, five five five, zero one nine nine"
    long = "word " * 20000 + "mail a@b.example"
    assert privacy.detect(long)[0][0] == 100005


def test_names_that_no_list_has(spark):
    r = random.Random(9)
    listed, surnames = sorted(privacy.GIVEN_NAMES), [a + b for a in ("Thorn", "Mar", "Gal", "Fen", "Hol") for b in ("quist", "lowe", "berg", "wick", "stein")]
    makers, things = ["Nestor", "Cargo", "Ledger", "Tally", "Quill"], ["Reports", "Exports", "Settings", "Invoices", "Tickets"]
    texts = [f"Yesterday {r.choice(listed)} {r.choice(surnames)} fixed the {r.choice(NAMES)} export." for _ in range(150)]
    texts += [f"We open {r.choice(makers)} {r.choice(things)} for {r.choice(NAMES)} invoices, reports and settings." for _ in range(150)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "id long, body string, author_name string, comment_sample_json string")
    model = privacy.fit_names(df)
    found = 0
    for name in ("Katarzyna Nowak", "Ravi Subramanian", "Ngozi Okafor", "Tomas Lindqvist", "Sinead Gallagher"):
        text = f"Yesterday {name} fixed the beta export."
        assert privacy.detect(text) == []
        found += privacy.redacted(text, model=model) == "Yesterday [PERSON_NAME] fixed the beta export."
    assert found >= 4
    for text in ("We open Nestor Ledgers for beta invoices.", "We open Grace Reports for beta invoices, reports and settings.", "Mark Settings"):
        assert privacy.detect(text, model=model) == [], text
    assert privacy.detect("Mark Settings") != []  # the rules alone know no common words
    assert privacy.fit_names(df.limit(20)).probability("Yesterday Ann Lee left", 10, 17, "Ann", "Lee") < 1e-9
    assert privacy.fit_names(df.limit(0)).common == frozenset()
    again = df.unionAll(spark.createDataFrame([(900, "Yesterday Ngozi Okafor fixed the beta export.", None, None), (None, None, None, None)], df.schema))
    assert {(x.id, x.pii_kind) for x in privacy.find_personal(again, model=model).where("id >= 900").collect()} == {(900, "person_name")}


def test_names_are_fitted_on_all_texts(spark, monkeypatch):
    r = random.Random(4)
    listed, surnames = sorted(privacy.GIVEN_NAMES), [a + b for a in ("Thorn", "Mar", "Gal", "Fen") for b in ("quist", "lowe", "berg", "wick")]
    others = [f"line {i} of a log that names nobody" for i in range(9000)]
    framed = [f"Yesterday {r.choice(listed)} {r.choice(surnames)} fixed export {i}." for i in range(300)]
    framed += [f"We open {r.choice(['Nestor', 'Cargo', 'Ledger', 'Tally'])} {r.choice(['Reports', 'Exports', 'Settings'])} for export {i}, reports, exports and settings." for i in range(300)]
    framed += [f"thornquist left in lower case {i}" for i in range(2)]
    low = spark.createDataFrame([(x,) for x in others], "body string").where(F.xxhash64("body") < 0)
    high = spark.createDataFrame([(x,) for x in framed], "body string").where("xxhash64(body) > 0 or body like 'thornquist%'")
    assert low.count() > 4200  # with more texts before them in the order of hashes than any sample had
    df = low.unionAll(high)
    model = privacy.fit_names(df)
    assert privacy.redacted("Yesterday Ngozi Okafor fixed export 7.", model=model) == "Yesterday [PERSON_NAME] fixed export 7."
    assert privacy.redacted("We open Nestor Ledgers for export 7.", model=model) == "We open Nestor Ledgers for export 7."
    assert {"settings", "line"} <= model.common and "thornquist" not in model.common  # twice in so many texts isn't common
    monkeypatch.setattr(privacy, "SMALL", 0)  # in tasks; other parts and repeated texts make no difference
    again = privacy.fit_names(df.unionAll(high).repartition(7))
    assert again.common == model.common and (again.weights == model.weights).all()


def test_redaction_of_tables(spark):
    rows = [(1, "a@b.org", "Kim", json.dumps(["c@d.org", "ok"])), (1, "a@b.org", "Kim", json.dumps(["c@d.org", "ok"])), (2, None, None, '["broken a@b.org'), (3, "", "[deleted]", "[]")]
    df = spark.createDataFrame(rows, "id long, body string, author_name string, comment_sample_json string").withColumn("field_name", F.lit(1))
    found = sorted((r.id, r.field_name, r.pii_kind) for r in privacy.find_personal(df).collect())
    assert found == [(1, "body", "email")] * 2 + [(1, "comment_sample_json", "email")] * 2 + [(2, "comment_sample_json", "email")]
    clean = {r.id: r for r in privacy.redact(df).collect()}
    assert clean[1].body == "[EMAIL]" and json.loads(clean[1].comment_sample_json) == ["[EMAIL]", "ok"] and clean[3].comment_sample_json == "[]" and clean[2].body is None
    assert privacy.find_personal(df.limit(0)).count() == 0


# 5


def brute_pairs(rows):
    sets = {}
    for i, title, body in rows:
        if body and len(WORD.findall(body.lower())) >= 40:
            w = WORD.findall(f"{title or ''} {body}".lower())
            sets[i] = set(zip(w, w[1:]))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def near_rows():
    r, rows = random.Random(3), []
    for k, t in enumerate(texts(60, 4)):
        for j in range(r.randrange(1, 4)):
            words = t.split()
            for _ in range(r.randrange(0, 7)):
                words[r.randrange(len(words))] = r.choice(NAMES)
            rows.append((len(rows), r.choice([None, "Title", f"T {k}"]), " ".join(words)))
    rows += [(len(rows) + i, "short", "too few words") for i in range(3)] + [(500, None, None), (501, "x", "")]
    same = texts(1, 99)[0]
    return rows + [(600 + i, "copy", same) for i in range(6)]


def test_near_duplicates(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "id long, title string, body string").withColumns({"fp": F.lit(1), "key": F.lit("k")})
    found = near_duplicates.NearDuplicates(df)
    want = brute_pairs(rows)
    got = [(r.id_a, r.id_b) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.98 * len(want)
    stars = {(r.id_a, r.id_b) for r in found.pairs(expand=3).collect()}
    assert {(600, 600 + i) for i in range(1, 6)} <= stars and not any(a > 600 and b > 600 for a, b in stars)
    groups = {r.id: (r.group_id, r.class_id) for r in found.groups().collect()}
    assert all(groups[a][0] == groups[b][0] for a, b in got) and groups[605] == (600, 600)
    assert near_duplicates.NearDuplicates(df.limit(0)).pairs().count() == 0


def test_hot_band_keys_give_all_pairs(spark, monkeypatch):
    keys, fps = np.array([7] * 300 + [9, 9, 8]), np.arange(303)
    df = spark.createDataFrame([(int(k), int(f)) for k, f in zip(keys, fps)] + [(7, 0)], "key long, fp long")
    real = near_duplicates._collisions(df).dropDuplicates().collect()
    assert len(real) == 300 * 299 // 2 + 1 and all(r.key is None for r in real)


@pytest.mark.parametrize("look, hot", [(320, 4096), (10**9, 4096), (2, 4096)])
def test_hot_keys_lose_no_pair(spark, monkeypatch, look, hot):
    # none, all and most keys of several texts are hot
    monkeypatch.setattr(near_duplicates, "LOOK_HOT", look)
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    rows = near_rows()
    got = {(r.id_a, r.id_b) for r in near_duplicates.NearDuplicates(spark.createDataFrame(rows, "id long, title string, body string").coalesce(2)).pairs().collect()}
    want = brute_pairs(rows)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_likely_pairs_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 9)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(120, 300)], rng.integers(0, 1 << 63, 60).astype(np.uint64)])) for _ in range(40)]
    registers = Family(near_duplicates.JOINT, first=1 << 20, base=near_duplicates.JOINT_BASE, q=near_duplicates.JOINT_Q).of_sets(sets)
    classes = spark.createDataFrame([(i, 100 + i, len(x), registers[i].tobytes()) for i, x in enumerate(sets)], "fp long, rep long, n long, registers binary")
    got = {(r.a, r.b) for r in near_duplicates._hot_pairs(spark.createDataFrame([(5, i) for i in range(40)] + [(5, 3)], "key long, fp long"), classes, 0.6).collect()}
    least = 0.6 - near_duplicates.MARGIN * (0.24 / near_duplicates.JOINT) ** 0.5
    n = np.array([float(len(x)) for x in sets])
    for i in range(40):
        for j in range(i + 1, 40):
            est = joint_similarity(registers[i][None], registers[j][None], n[i : i + 1], n[j : j + 1], near_duplicates.JOINT_BASE)[0]
            if abs(est - least) > 1e-3:
                assert ((i, j) in got) == (est >= least and min(n[i], n[j]) >= 0.6 * max(n[i], n[j])), (i, j, est)


def test_bands_keep_their_recall():
    for rows, width in ((0, 7), (10**7, 7), (10**8, 8), (10**9, 9)):
        bands, own = near_duplicates.shape(rows, 0.6)
        assert own == width and 1 - (1 - 0.6**own) ** bands >= near_duplicates.RECALL
    assert near_duplicates.shape(1000, 0.6)[0] == 80


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    a, b = x[:400], x[200:]
    f = Family(2048, base=1.1, q=254)
    ra, rb, rab = f.of_sets([a, b, x])
    assert (np.maximum(ra, rb) == rab).all() and (f.of_sets([np.empty(0, np.uint64)]) == 0).all()
    est = joint_similarity(ra[None], rb[None], np.array([400.0]), np.array([400.0]), 1.1)[0]
    assert abs(est - 200 / 600) < 0.04
    fine = Family(2048)
    u, v = fine.of_sets([a, b])
    assert abs((u == v).mean() - 200 / 600) < 0.05
    assert band_keys(np.zeros((2, 14), np.uint16), 2).shape == (2, 2)


# 6


def test_encoding_matches_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(encoding.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(0)
    parts = ["a", "word", " ", "  ", "\n", "\t", " ", "é", "中文", "'s", "123", "!?", "\r\n", "\x1c", "​", "🙂", "<|endoftext|>", "http://x.y/z"]
    rows = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(1500)] + ["x" * 20000, "ab" * 9000, "", None]
    df = spark.createDataFrame(list(enumerate(rows)) + [(None, "a b")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {x.doc_id: x.ids for x in encoding.encode_corpus(df).collect()}
    want = t.encode_batch([x or "" for x in rows], add_special_tokens=False)
    assert all(got[i] == want[i].ids for i in range(len(rows))) and got[len(rows) - 1] == [] and len(got[None]) == 2
    back = {x.doc_id: x.text for x in encoding.decode_corpus(encoding.encode_corpus(df)).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(rows))
    assert encoding.encode_corpus(df.limit(0)).count() == 0


def test_merge_against_the_plain_rule():
    ranks = ranks_of(encoding.VOCABULARY)
    r = random.Random(2)
    for _ in range(300):
        piece = "".join(r.choice("aabcdelnrst") for _ in range(r.randrange(1, 25))).encode()
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert merge(piece, ranks) == [ranks[p] for p in parts]


# 7


def test_leaks(spark):
    items = [(f"e{i}", t) for i, t in enumerate(texts(8, 11, 30))] + [("short", "only four words here"), ("null", None), ("e0b", texts(8, 11, 30)[0])]
    r, docs = random.Random(5), []
    for i in range(120):
        words = texts(1, 1000 + i, 50)[0].split()
        if i % 2:
            source = items[r.randrange(8)][1].split()
            n, at = r.randrange(9, 16), r.randrange(14)
            words[20:20] = source[at : at + n]
        sep = r.choice([" ", ", ", "\n\n- ", " — "])
        docs.append((i, sep.join(w.upper() if r.random() < 0.1 else w for w in words)))
    docs += [(900, None), (901, ""), (902, "x" * 50000), (1, docs[1][1])]
    ngrams = {}
    for p, b in items:
        w = WORD.findall((b or "").lower())
        for k in range(len(w) - 11):
            ngrams.setdefault(tuple(w[k : k + 12]), set()).add(p)
    want = sorted((d, p) for d, p in ((d, p) for d, t in docs for p in set().union(*(ngrams.get(tuple(w[k : k + 12]), ()) for w in [WORD.findall((t or "").lower())] for k in range(max(0, len(w) - 11))), set())))
    df, ev = spark.createDataFrame(docs, "doc_id long, text string").withColumn("post_id", F.lit("clash")), spark.createDataFrame(items, "post_id string, body string")
    got = leakage.find_leaks(df, ev).collect()
    assert sorted((x.doc_id, x.post_id) for x in got) == want and all(x.run_words >= 12 for x in got)
    assert leakage.find_leaks(df.limit(0), ev).count() == 0 and leakage.find_leaks(df, ev.limit(0)).count() == 0


def aligned_brute(doc, item, edits):
    """Most equal words of an alignment with at most so many edits, by the full table."""
    best = 0
    table = [[[0] * (len(item) + 1) for _ in range(len(doc) + 1)] for _ in range(edits + 1)]
    for e in range(edits + 1):
        for i in range(1, len(doc) + 1):
            for j in range(1, len(item) + 1):
                v = table[e][i - 1][j - 1] + 1 if doc[i - 1] == item[j - 1] else 0
                if e:
                    v = max(v, table[e - 1][i - 1][j - 1], table[e - 1][i - 1][j], table[e - 1][i][j - 1])
                table[e][i][j] = v
                best = max(best, v)
    return best


@pytest.mark.parametrize("edits", [1, 2])
def test_leaks_with_edits(spark, edits):
    r = random.Random(edits)
    items = [(f"e{i}", t) for i, t in enumerate(texts(5, 21, 30))]
    docs = []
    for i in range(80):
        words = items[i % 5][1].split()[r.randrange(12) :][: r.randrange(9, 18)]
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(words))
            kind = r.randrange(3)
            words[at : at + (kind != 1)] = [r.choice([*NAMES, "x" * 90])] if kind != 2 else []
        docs.append((i, " ".join([*texts(1, 500 + i, 20), *words, *texts(1, 900 + i, 20)])))
    want = {(i, p) for i, t in docs for p, b in items if aligned_brute(t.split(), b.split(), edits) >= 12}
    df, ev = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "post_id string, body string")
    assert {(x.doc_id, x.post_id) for x in leakage.find_leaks(df, ev, edits=edits).collect()} == want
    exact = {(x.doc_id, x.post_id) for x in leakage.find_leaks(df, ev).collect()}
    assert exact == {(i, p) for i, t in docs for p, b in items if aligned_brute(t.split(), b.split(), 0) >= 12} and exact < want


def test_one_short_item_lets_no_more_through():
    items = [(f"e{i}", leakage.plain(t)) for i, t in enumerate(texts(6, 31, 40))]
    tiny = ("tiny", leakage.plain("a b c d e f g h i j k l"))
    one, two = leakage.Index(items, 12, 0), leakage.Index([*items, tiny], 12, 0)
    r = random.Random(8)
    pool = [w for _, t in items for w in t.decode().split()]
    text = leakage.plain(" ".join(r.choice(pool) for _ in range(20000)))  # many shared q-grams, hardly a passage
    assert (one.least == two.least[:-1]).all() and two.least[-1] < one.least.min() // 2
    assert len(two.regions(text)) == len(one.regions(text)) < 0.02 * len(text)
    whole = b"".join([text, items[2][1], tiny[1]])
    at = two.regions(whole)
    found = two.bands(*two.shared(whole, np.array([0]), at))
    assert {k for _, k, *_ in found} == {2, 6}


# 8


def test_pieces(spark):
    e = Encoder(splitting.VOCABULARY)
    rows = [(1, None), (2, ""), (3, "short text"), (4, ". ".join(texts(60, 1, 12))), (5, "x" * 9000), (6, "中文字" * 1500), (7, "\n" * 4000), (8, "one two\n\n three \n" * 700), (9, "🙂" * 1200), (10, "a" + " " * 3000 + "b"), (3, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = {}
    for r in sorted(splitting.split_corpus(df).collect(), key=lambda r: (r.doc_id, r.piece_no)):
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[3]) == 2  # a repeated row
    for i, text in dict(rows).items():
        ps, text = got[i][:1] if i == 3 else got[i], text or ""
        assert [p.piece_no for p in ps] == list(range(len(ps))) and ps[0].char_start == 0 and ps[-1].char_end == len(text)
        assert (len(ps) > 1) == (len(e.encode(text)) > 512)
        for a, b in zip(ps, ps[1:]):
            assert a.char_start < b.char_start <= a.char_end < b.char_end
            assert len(e.encode(text[b.char_start : a.char_end])) <= 64
        for p in ps:
            assert p.piece == text[p.char_start : p.char_end] and p.n_tokens == len(e.encode(p.piece)) <= 512
    assert all(p.piece.rstrip().endswith(".") or p.char_end == len(rows[3][1]) for p in got[4] if p.piece)
    assert splitting.split_corpus(df.limit(0)).count() == 0


def test_doubling_gives_the_greedy_cuts():
    r = random.Random(4)
    for _ in range(50):
        steps = np.cumsum([r.randrange(1, 30) for _ in range(300)])
        before = np.concatenate([[0], steps])
        kinds = np.array([r.choice([1, 1, 1, 2, 3]) for _ in before], np.int8)
        kinds[0] = kinds[-1] = 3
        end, nxt = splitting.successors(before, kinds, np.array([0, len(before)]), 100, 20)
        assert (before[end] - before[np.arange(len(before))] <= 100).all()
        seen, at = [0], 0
        while nxt[at] != at:
            assert before[end[at]] - before[nxt[at]] <= 20 and nxt[at] > at
            at = int(nxt[at])
            seen.append(at)
        assert splitting.cuts(nxt, np.array([0])).tolist() == seen


# all


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLE:
        assert oracle.rows_of(df) == oracle.sql_rows(oracle.connect(sf_dir), queries.ORACLE[name])
    else:
        assert df.count() > 0
