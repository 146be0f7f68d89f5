"""Languages, bodies, spam, residue and encodings on hand-made pages."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from tesserine.llm import encoding, language, residue, spam, template
from tesserine.llm.encoding import Analyser

COLUMNS = "fetch_id long, url string, domain string, html string, text string, lang string, title string, meta_description string, error_code string, slot long, words int, label string, id int"


@pytest.fixture(scope="module")
def samples(spark, sf):
    return spark.read.parquet(f"{sf}/lang_samples.parquet")


@pytest.fixture(scope="module")
def rows(samples):
    return encoding.samples_of(samples)


@pytest.fixture(scope="module")
def an(rows):
    return Analyser(rows)


def table(spark, pages):
    return spark.createDataFrame([(p.get("fetch_id"), "u", p.get("domain"), p.get("html"), p.get("text"), p.get("lang"), p.get("title"), p.get("meta"), None, 1, 2, "x", 3) for p in pages], COLUMNS)


# -- encodings ---------------------------------------------------------------------
WRONG = ("cp1252", "latin_1", "cp1251", "cp437", "mac_roman", "cp850")


@pytest.mark.parametrize("page", WRONG)
@pytest.mark.parametrize("good", ["La montaña describe la habitación", "Прогулка через каждый музей", "“Größere” – Mühle", "Ten żagiel łączy wieś", "prix 12 €", "Καλημέρα κόσμε"])
def test_utf8_misread_is_restored(an, page, good):
    raw = good.encode("utf-8")
    bad = "".join(encoding._CHAR[page][b] if b > 127 else chr(b) for b in raw)
    assert an.affected(bad) and an.restore(bad) == (good, True)


@pytest.mark.parametrize("page", ("cp1252", "latin_1", "cp1251"))
def test_letters_of_no_sampled_language(an, page):
    good = "Příliš žluťoučký kůň"
    bad = "".join(encoding._CHAR[page][b] if b > 127 else chr(b) for b in good.encode("utf-8"))
    assert an.affected(bad) and an.restore(bad) == (good, True)


def test_twice_misread(an):
    bad = "château près".encode().decode("latin_1").encode().decode("latin_1")
    assert an.affected(bad) and an.restore(bad)[0] == "château près"


def test_single_byte_pages(an, rows):
    ru = next(t for lang, t in rows if lang == "ru")
    bad = ru.encode("cp1251", "replace").decode("cp1252", "replace")
    assert an.affected(bad)
    koi = ru.encode("koi8_r", "replace").decode("cp1251", "replace")
    assert an.affected(koi)


def test_lost_characters(an):
    for bad in ("La monta�a", "la habitaci?n está", "texto \x96 y"):
        assert an.affected(bad) and not an.restore(bad)[1]


@pytest.mark.parametrize(
    "good",
    ["", None, "plain ascii? yes", "Ærø Ðal Þór", "ÂNCORA, SÃO", "naïve café – “so” … 5 € · 3 µm ± 2", "СССР ТРЁХ ЕЩЁ", "Dvořák, Škoda, Győr", "¿Qué? ¡Sí!", "http://a.example/?q=x&b?c", "Київ є столицею України, її історія", "What is this?yes it is", "Really?no way", "┌──┐ │ x │ └──┘", "« Été » à"],
)
def test_right_text_is_left_alone(an, good):
    assert not an.affected(good)


def test_encoding_table(spark, samples):
    t = table(spark, [{"fetch_id": 1, "text": "monta├▒a", "html": "<p>montaña</p>"}, {"fetch_id": 1, "text": "monta├▒a", "html": None}, {"fetch_id": None, "text": "monta├▒a"}, {"fetch_id": 2}, {"fetch_id": 3, "text": "x" * 200_000 + "é"}])
    assert [tuple(r) for r in encoding.found(t, samples).collect()] == [(1, "text")]
    assert encoding.found(t.limit(0), samples).count() == 0
    assert encoding.found(t, samples.limit(0)).count() == 1
    assert all(r["restored"] == "montaña" and r["lossless"] for r in encoding.restored(t, samples).collect())



def crowded(samples):
    """The samples behind 600 rows of each language that say nothing and sort first."""
    return samples.union(samples.sparkSession.range(600).crossJoin(samples.select("lang").distinct()).selectExpr("-id", "lang", "'!'"))


def test_letter_pairs_of_every_sample(spark, samples, rows):
    ru = next(t for lang, t in rows if lang == "ru")
    t = table(spark, [{"fetch_id": 1, "text": ru.encode("cp1251", "replace").decode("cp1252", "replace")}, {"fetch_id": 2, "text": ru}])
    assert [tuple(r) for r in encoding.found(t, crowded(samples)).collect()] == [(1, "text")]
    assert [r["lossless"] for r in encoding.restored(t, crowded(samples)).collect()] == [True]
    assert encoding.pairs_of(crowded(samples)) == encoding.pairs_of(samples) == encoding.count_pairs(rows)


# -- languages ------------------------------------------------------------------------
@pytest.fixture(scope="module")
def crf(rows):
    return language.fit(rows)


def test_held_out_words(rows):
    train, test = rows[::2], rows[1::2]
    model = language.fit(train)
    right = total = 0
    for (lang, _), m in zip(test, model.marginals([language.read_words(t)[0] for _, t in test])):
        right += int((m.argmax(1) == model.langs.index(lang)).sum())
        total += len(m)
    assert right / total > 0.97


def test_every_sample_is_learnt(spark, samples, rows):
    t = table(spark, [{"fetch_id": 1, "text": " ".join(t for lang, t in rows if lang == "pl")}])
    got = {r["lang"]: r["share"] for r in language.labels(t, crowded(samples), "fetch_id", ["text"]).collect()}
    assert got.get("pl", 0) > 0.9


def test_training_in_blocks(rows, monkeypatch):
    some = rows[::4]
    whole = language.fit(some)
    assert language.unpack(language.pack(whole)) is language.unpack(language.pack(whole))
    assert np.array_equal(language.unpack(language.pack(whole)).weights, whole.weights)
    monkeypatch.setattr(language, "CELLS", 2000)
    assert len(list(language._blocks([150] * 40))) == 4
    parts = language.fit(some)
    for _, t in rows[1::9]:
        q = language.read_words(t)[0]
        assert np.allclose(whole.marginals([q])[0], parts.marginals([q])[0], atol=0.02)


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    a = np.exp(r.normal(size=(3, 3)))
    for n in (1, 2, 5):
        e = np.exp(r.normal(size=(n, 3)))
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.prod([e[i, y] for i, y in enumerate(path)]) * np.prod([a[x, y] for x, y in zip(path, path[1:])])
            for i, y in enumerate(path):
                want[i, y] += w
        pad = np.ones((7, 2, 3), np.float32)
        pad[:n, 0] = e
        pad[:, 1] = np.exp(r.normal(size=(7, 3)))
        got, _ = language.forward_backward(pad, a.astype(np.float32), [n, 7])
        assert np.allclose(got[:n, 0], want / want.sum(1, keepdims=True), atol=1e-4)


def test_mixed_and_quoted(crf, rows):
    by = {x: [t for lang, t in rows if lang == x] for x in ("en", "de", "ru")}
    mixed = by["en"][0] + "\n" + by["de"][0] + " " + by["de"][1]
    got = language.judge_batch(crf, [(mixed, frozenset()), (by["en"][1] + "\n" + by["en"][2] + " “" + by["ru"][0].split(".")[0] + "”", frozenset()), ("", frozenset()), ("… 12 34", frozenset())])
    assert set(got[0]) == {"en", "de"} and set(got[1]) == {"en"} and got[2] == {}
    assert all(0.5 < c <= 1 for _, c in got[0].values())


@pytest.mark.parametrize("label, code", [("de-AT", "de"), ("DEU", "de"), ("fr_ca", "fr"), ("xx", None), ("", None), (None, None), ("unknown", None), ("rus", "ru"), ("klingon", None)])
def test_label_codes(label, code):
    assert language.label_code(label) == code


def test_language_tables(spark, samples, rows):
    en = " ".join(t for lang, t in rows if lang == "en")
    t = table(spark, [{"fetch_id": 1, "text": en, "lang": "de", "domain": "a", "meta": en}, {"fetch_id": 2, "text": en, "lang": "EN-gb", "domain": "a"}, {"fetch_id": 3}, {"fetch_id": 3}, {"fetch_id": 4, "text": "", "lang": "en"}])
    assert sorted(tuple(r) for r in language.found(t, samples).collect()) == [(1, "meta_description", "en"), (1, "text", "en")]
    labels = language.labels(t, samples, "fetch_id", ["text"]).collect()
    assert {(r["fetch_id"], r["lang"]) for r in labels} == {(1, "en"), (2, "en")}
    assert language.found(t.limit(0), samples).count() == 0 and language.labels(t, samples.limit(0), "fetch_id", ["text"]).count() == 0
    assert language.segments(t, samples, "fetch_id").count() == 0


# -- bodies, residue, spam -------------------------------------------------------------
def page(i, rows, host, menu=("Home", "News"), body=None):
    body = body or [rows[(3 * i + k) % len(rows)][1] for k in range(3)]
    html = (
        "<html><head><title>t</title></head><body><div class='nav'><ul>" + "".join(f"<li><a href='/{m}'>{m}</a></li>" for m in menu) + "</ul></div><div id=content>"
        + "".join(f"<p>{b}</p>" for b in body) + f"</div><div class='foot'>All rights {host}</div></body></html>"
    )
    return {"fetch_id": i, "domain": host, "html": html, "text": "\n".join([*menu, "", *body, f"All rights {host}"])}


def test_furniture(spark, samples, rows):
    pages = [page(i, rows, f"h{i % 3}.example") for i in range(18)] + [page(100 + i, rows, f"one{i}.example") for i in range(6)]
    pages.append({**page(200, rows, "h0.example"), "html": None})
    pages += [{"fetch_id": 300, "domain": "h0.example"}, {"fetch_id": 301, "domain": None, "text": " \n\n"}]
    t = table(spark, pages)
    got = {(r["fetch_id"], r["line_no"]) for r in template.found(t, samples).collect()}
    assert got == {(p["fetch_id"], n) for p in pages if p["fetch_id"] < 300 for n in (0, 1, 6)}
    body = {r["fetch_id"]: r["body"] for r in template.bodies(t, samples).collect()}
    assert body[0].strip() == "\n".join(pages[0]["text"].split("\n")[3:6])
    assert template.found(t.limit(0), samples).count() == 0


def test_furniture_by_every_sample(spark, samples, rows):
    """The repair of a garbled menu and the refusal of a spam page need samples that sort last."""
    ru = max((w for lang, t in rows if lang == "ru" for w in t.split() if w.isalpha()), key=len)
    wrong = ru.encode("cp1251").decode("cp1252")
    pages = [page(i, rows, "h.example", menu=("Home", ru)) for i in range(8)]
    pages[0]["text"] = pages[0]["text"].replace(ru, wrong)
    pages.append(page(20, rows, "h.example", menu=("Home", ru), body=[SPAM[0] * 3] * 3))
    t = table(spark, pages)
    got = {(r["fetch_id"], r["line_no"]) for r in template.found(t, crowded(samples)).collect()}
    assert got == {(i, n) for i in range(8) for n in (0, 1, 6)}


def test_body_slot_is_of_a_valid_class(spark, samples, rows):
    pages = [page(i, rows, "h.example") for i in range(8)]
    promo = " ".join(t for _, t in rows[:12])
    pages[0]["html"] = pages[0]["html"].replace("<div class='foot'>", f"<div class='promo'><p>{promo}</p></div><div class='foot'>")
    pages[0]["text"] += "\n" + promo
    got = {r["line_no"] for r in template.found(table(spark, pages), samples).where("fetch_id = 0").collect()}
    assert got == {0, 1, 6, 7}


def test_template_text_is_of_a_class(spark, samples, rows):
    """A text on most pages is template if other tokens stand on the same pages."""
    pages = []
    for i in range(12):
        p = page(i, rows, "h.example")
        add = ("<p>Alone among its pages</p>" if i < 9 else "") + ("<p>Always first</p><p>Always second</p>" if i > 1 else "")
        pages.append({**p, "html": p["html"].replace("<div id=content>", "<div id=content>" + add)})
    _, texts = template.classes(template.parsed(table(spark, pages), samples))
    tok = {k: template._id(str(template._id("divicontent")), template.key_of(k)) for k in ("Alone among its pages", "Always first", "Always second")}
    got = {r["tok"] for r in texts.collect()}
    assert tok["Alone among its pages"] not in got and {tok["Always first"], tok["Always second"]} <= got


def test_class_out_of_order_is_not_valid(spark, samples, rows):
    pages = []
    for i in range(4):
        boxes = ["<div class='x'><p>a</p></div>", "<div class='y'><p>b</p></div>"]
        p = page(i, rows, "h.example")
        pages.append({**p, "html": p["html"].replace("<div id=content>", "".join(boxes[:: 1 if i % 2 else -1]) + "<div id=content>")})
    boxes, _ = template.classes(template.parsed(table(spark, pages), samples))
    assert template._id("divcx") not in {r["tok"] for r in boxes.collect()}


def test_classes_decide_the_body(spark, samples, rows, monkeypatch):
    """On these pages a notice is longer than the body: only the host's template tells them apart."""
    notice = " ".join(t for _, t in rows[:4])
    pages = [page(i, rows, "h.example", body=[rows[3 * i][1]]) for i in range(6)]
    for p in pages[:3]:
        p["html"] = p["html"].replace("<div class='foot'>", f"<section><p>{notice} {p['fetch_id']}</p></section><div class='foot'>")
        p["text"] += f"\n{notice} {p['fetch_id']}"
    pages += [page(20 + i, rows, "h.example") for i in range(6)]
    t = table(spark, pages)
    with_ = {tuple(r) for r in template.found(t, samples).collect()}
    assert {(i, 5) for i in range(3)} <= with_ and not any(n == 3 for _, n in with_)
    none = spark.createDataFrame([], "domain string, tok long")
    monkeypatch.setattr(template, "classes", lambda _: (none, none))
    assert {tuple(r) for r in template.found(t, samples).collect()} != with_


def test_segments_of_broken_html():
    got = template.segments("<div><p>a <b>b</b> c<li>d</div></div><nav>x &amp; y<script>no()</script>")
    assert [(p, t) for p, t in got if t][:1] == [(("div.",), "a")] and (("div.",), "a b c") in got and (("nav.",), "x & y") in got


def test_places():
    got, unfilled = residue.page_places("Hi {{ name }} and ${city} [INSERT PHONE HERE] %%DATE%% plain", "[object Object]")
    assert {n for n, _ in got} == {"name", "city", "insert", "phone", "here", "date"} and unfilled
    assert residue.page_places("no places, 5 < 6 & 7", None) == ([], False)
    same = [residue.page_places(f"It shows how {{{{ {w} }}}} is replaced by {n}", None)[0][0][1] for w, n in (("roof", 1), ("mill", 2))]
    assert same[0] == same[1]


@pytest.mark.parametrize("slot", ["{{ title.phone }}", "{{ cart_total }}", "${customer}", "{name}", "{{ first-name }}", "{{ name | upper }}", "*|NAME|*", "{% block x %}", "@@x@@"])
def test_slot_is_judged_in_its_place(slot):
    """One syntax and one name are enough where nothing but the placeholder stands."""
    for text, title in (("", slot), ("", slot + " | Shop"), ("", "Shop - " + slot), (f"Menu\nTotal: {slot}\nmore", None)):
        assert residue.page_places(text, title)[1]
    assert not residue.page_places(f"Our course shows how {slot} is replaced.\nNote: write {slot} there", "How templates work")[1]


def test_templates_are_aligned():
    a, b = "Exception in thread city-57800: overflow at Zeclu.render", "Exception in thread hours-1: overflow at Bedu.render"
    assert residue.line_mask(a) != residue.line_mask(b) and residue.line_mask(a) == residue.line_mask(a.replace("57800", "4"))
    assert {h for h, _ in residue.left_out(a)} & {h for h, _ in residue.left_out(b)}
    assert residue._hash(residue.template_of(residue.parts(a))[0]) == residue.line_mask(a)
    assert residue.left_out("Warm roof") == [] and residue.line_mask("") == residue.line_mask(" ")


def residue_of(spark, samples, pages):
    t = table(spark, pages)
    parsed = template.parsed(t, samples)
    return {r["fetch_id"] for r in residue.found(parsed, template.judged_lines(parsed), t).collect()}


def test_residue(spark, samples, rows):
    latin = "viverra mollis augue pretium congue rutrem sodal dictus".split()
    pages = [page(i, rows, f"h{i}.example") for i in range(8)]
    pages += [page(20 + i, rows, "p.example", body=[rows[i][1] + " Dear {{ name }}, your order follows.", rows[i + 9][1]]) for i in range(4)]
    pages += [page(40 + i, rows, f"q{i}.example", body=[rows[i][1] + f" A course shows how {{{{ {w} }}}} is replaced.", rows[2 + i][1]]) for i, w in enumerate(("reporter", "garden", "soup"))]
    pages += [page(50 + i, rows, f"e{i}.example", body=[f"Error {4000 + i}: page Xk{i} was not found"]) for i in range(4)]
    pages += [page(60 + i, rows, f"l{i}.example", body=[" ".join(latin[i:] + latin[:i]).capitalize() + "."] * 4) for i in range(4)]
    pages += [page(70 + i, rows, f"m{i}.example", body=[f"Exception in thread {w}-{i}: stack overflow"]) for i, w in enumerate(("city", "phone", "date", "price"))]
    pages += [{**page(100 + i, rows, f"t{i}.example"), "title": "Untitled document"} for i in range(30)]
    pages += [{**page(200 + i, rows, f"u{i}.example"), "title": " ".join(rows[3 * (200 + i) % len(rows)][1].split()[:3])} for i in range(60)]
    got = residue_of(spark, samples, pages)
    assert got == {20, 21, 22, 23, *range(50, 54), *range(60, 64), *range(70, 74), *range(100, 130)}
    assert residue_of(spark, samples, []) == set()


def test_copies_are_no_message(spark, samples, rows):
    """The same long page on many domains is a copy; one whose values all change is a message."""
    long = " ".join(t for lang, t in rows if lang == "en").split()[:60]
    pages = [page(i, rows, f"c{i}.example", body=[" ".join(long)]) for i in range(6)]
    pages += [page(20 + i, rows, f"d{i}.example", body=[" ".join(f"error {i * 7 + k} at Xq{chr(97 + i)}{k} in module" for k in range(12))]) for i in range(6)]
    assert residue_of(spark, samples, pages) == set(range(20, 26))


SPAM = [
    "lesson red, lesson blue, road red, lesson blue, road red, road blue, lesson red, " * 6,
    " ".join(f"#roof{x} #mill{x}" for x in "abcabcabcabc" * 3),
    "\n".join(f"Old mill behind the roof - http://a.example/{i}" for i in range(12)),
    "\n".join(f"Kratu mill T{i}41 {i}.50 [red|roof]" for i in range(12)),
    "parcel Kratu parcel parcel road parcel Kratu parcel road parcel " * 8,
]


@pytest.mark.parametrize("text", SPAM)
def test_spam_is_found(an, rows, text):
    prose = spam.model_of(tuple(rows))
    assert spam.judge(text, prose, an)[0] and spam.judge(rows[0][1] + "\n" + text, prose, an)[0]


def test_prose_is_not_spam(an, rows):
    prose = spam.model_of(tuple(rows))
    for lang in sorted({x for x, _ in rows}):
        t = " ".join(x for y, x in rows if y == lang)
        assert not spam.judge(t, prose, an)[0] and not spam.judge(t.upper(), prose, an)[0]
        assert not spam.judge(t + "\n" + SPAM[0][:120], prose, an)[0]
    assert spam.judge(None, prose, an) is None and spam.judge("few words", prose, an) is None


def test_bounds_come_from_held_out_prose(rows):
    mean, sd, tokens = spam.model_of(tuple(rows)).bounds
    assert 0 < sd < mean and tokens > spam.WINDOW
    assert spam.model_of(()).bounds == (0.0, np.inf, 1.0)
    prose = spam.model_of(tuple(rows))
    low = spam.ProseModel(rows)
    low.bounds = (20.0, 0.5, 100.0)
    assert spam.judge_right(SPAM[0], low, False)[0] and not spam.judge_right(" ".join(t for _, t in rows[:5]), prose, False)[0]


def test_prose_of_every_sample(spark, samples, rows):
    """Learnt where the samples lie as from a list of them; none is left out."""
    here, there = spam.model_of(tuple(rows)), spam.prose_of(spam.learn(samples))
    assert here.function == there.function and np.array_equal(here.keys, there.keys) and np.array_equal(here.counts, there.counts)
    assert np.array_equal(here.two, there.two) and np.array_equal(here.context, there.context) and np.allclose(here.bounds, there.bounds, rtol=1e-12)
    assert np.allclose(spam.learn(samples.union(samples).union(samples))[3], here.bounds, rtol=1e-12)
    more = crowded(samples)
    assert spam.prose_of(spam.learn(more)).function >= here.function
    t = table(spark, [{"fetch_id": 1, "text": SPAM[0]}, {"fetch_id": 2, "text": " ".join(x for _, x in rows[:5])}])
    assert [r[0] for r in spam.found(t, more).collect()] == [1]
    assert all(spam.learn(samples.limit(n))[3][1] == np.inf for n in (0, 1))


def test_batches_are_bounded_by_words(crf, rows):
    long = " ".join(t for _, t in rows) * 20
    words_ = [language.read_words(t)[0] for t in (long, rows[0][1], "", rows[1][1])]
    got = crf.marginals(words_)
    assert [len(g) for g in got] == [len(w) for w in words_]
    assert np.allclose(got[1], crf.marginals([words_[1]])[0], atol=1e-4)


def test_spam_table(spark, samples):
    t = table(spark, [{"fetch_id": 1, "text": SPAM[0], "domain": "A"}, {"fetch_id": 1, "text": SPAM[0], "domain": "A"}, {"fetch_id": None, "text": SPAM[0]}, {"fetch_id": 2}, {"fetch_id": 3, "text": "x" * 100_000}])
    assert [r[0] for r in spam.found(t, samples).collect()] == [1]
    assert spam.found(t.limit(0), samples).count() == 0 and spam.found(t, samples.limit(0)).count() == 0
    v = spark.createDataFrame([(" a ", "news"), ("a", None)], "domain string, old_category string")
    t2 = table(spark, [{"fetch_id": 1, "text": SPAM[0], "domain": "a"}])
    assert [(r["old_category"], r["spam_pages"]) for r in spam.by_category(t2, v, samples).collect()] == [("news", 1)]
