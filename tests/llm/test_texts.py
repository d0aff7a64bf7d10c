import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetables.llm import html_text, langid, markup, minhash, pii
from edgetables.llm.shingles import shingle_sets
from tests.reference_labels import labels

SCHEMA = "doc_id long, text string, kept string"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            if kind == "ip" and any(int(part) > 255 for part in match[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and passes_luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((match.start(), order, match.end()))
    return sorted(out)


def test_base_patterns_match_plain_search(spark):
    rng = random.Random(6)
    pool = ["a@b.co", "x_d@e.fr", "@", ".", "-", " ", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "4111111111111111",
            "4111 1111 1111 1111", "+1 (487) 555-7209", "+12", "é🙂", "..a%b@c-d.e.f", "7", "\n", "+", "a@b@c.de", "(", ")"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(600)]
    texts += ["a" * 60_000, "1 " * 40_000 + "x", "a@b" + ".c" * 30_000, "1.2.3.4 " * 500, "+1" + "-" * 30_000, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.find(frame, ["doc_id"]).collect()}
    for doc_id, text in enumerate(texts):
        assert got[doc_id] == base_spans(text or ""), repr((text or "")[:80])


def test_context_finds_unseen_identifiers_and_leaves_others(spark):
    rng = random.Random(1)
    texts = [f"please call me at +1 ({n}) 555-{1000 + n} soon" for n in range(200, 230)]
    texts += ["please call me at 0049-30-5550001 soon", "order number 0049-30-5550001x and page 12345678 follow"]
    texts += [f"order number {rng.randrange(10**7, 10**8)} and server 10.0.0.{k}" for k in range(30)]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    found = pii.find(frame)
    rows = {r["doc_id"]: r for r in found.withColumn("names", pii.span_names("spans")).collect()}
    assert rows[30]["names"] == f"phone_context:{texts[30].index('0049')}:{texts[30].index(' soon')}"
    assert rows[30]["base"] == [] and rows[31]["names"] == ""
    assert all(rows[k]["names"] == pii_names(texts[k]) for k in [*range(30), *range(32, len(texts))])
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert redacted[0] == "please call me at [PHONE] soon" and redacted[30] == "please call me at [PHONE] soon"
    assert redacted[31] == texts[31]


def test_candidates_have_the_shapes_of_the_kinds(spark):
    unseen = [
        ("call me at ", "(487) 555-7209"), ("call me at ", "0171 555 7209"), ("write me to ", "jane.doe@localhost"),
        ("10.0.0.1 and 42 call me at ", "0171/555 7209"), ("позвоните на номер ", "0171 555 7209"),
        ("call me at ", "0171-555-7209x"),
    ]
    texts = [before + value + "." for before, value in unseen]
    texts += [f"call me at +1 ({n}) 555-{1000 + n} soon" for n in range(200, 240)]
    texts += [f"write me to a{n}@b.co soon" for n in range(20)] + [f"позвоните на номер +49 30 555{1000 + n}" for n in range(20)]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    rows = {r["doc_id"]: r["names"].split(",") for r in pii.find(frame).withColumn("names", pii.span_names("spans")).collect()}
    for k, (before, value) in enumerate(unseen):
        kind = "email" if "@" in value else "phone"
        assert rows[k][-1] == f"{kind}_context:{len(before)}:{len(before) + len(value)}"


def test_contexts_are_found_until_no_more_cross_the_threshold(spark):
    def phones(first, n):
        return [f"0049-30-{first + k}" for k in range(n)]

    words = ["call me at", "reach us under", "our new line", "dial please quickly", "night desk number"]
    texts = [f"ring us at +4940{1000000 + k}" for k in range(100)] + [f"ring us at {p}" for p in phones(7000000, 100)]
    texts += [f"{words[0]} +4930{1000000 + k}" for k in range(200)] + [f"{words[0]} {p}" for p in phones(1000000, 80)]
    # Each context shares instances with the one before only; those of the last are four hops from the seeds.
    for step in range(1, len(words)):
        shared = phones(1000000 * step, 160 >> step)
        texts += [f"{words[step]} {p}" for p in shared + phones(1000000 * (step + 1), 80 >> step)]
    last = f"{words[-1]} 0049-30-{1000000 * len(words)}"
    # One card number in ten among others passes by chance.
    orders = [f"order number {10**15 + k * 10**5 + 7}" for k in range(200)]
    assert 3 <= sum(passes_luhn(t.split()[-1]) for t in orders) < 40
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts + orders)], SCHEMA)
    rows = {r["text"]: r["names"] for r in pii.find(frame).withColumn("names", pii.span_names("spans")).collect()}
    assert [t for t in texts if not rows[t].startswith("phone")] == []
    assert rows[last] == f"phone_context:{len(words[-1]) + 1}:{len(last)}"
    assert all(rows[t] == pii_names(t) for t in orders)


def test_long_texts_with_many_matches(spark):
    rng = random.Random(8)
    words = ["é🙂" * 700, "mail me at a@b.co", "server 10.0.0.1", "call me at +1 (487) 555-7209", "card 4111 1111 1111 1111", "\n"]
    texts = [" ".join(rng.choices(words, [1, 60, 60, 60, 60, 20], k=n)) for n in (300, 1500, 3000)] + ["x" * 4095 + " a@b.co"]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    found = pii.find(frame)
    rows = {r["doc_id"]: r for r in found.collect()}
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    for k, text in enumerate(texts):
        assert [tuple(s) for s in rows[k]["base"]] == base_spans(text)
        want, at = [], 0
        for start, kind, end in sorted(tuple(s) for s in rows[k]["spans"]):
            want += [] if start < at else [text[at:start], f"[{pii.KINDS[kind % 4].upper()}]"]
            at = max(at, end)
        assert redacted[k] == "".join(want) + text[at:]


def pii_names(text):
    return ",".join(f"{pii.KINDS[kind]}:{start}:{end}" for start, kind, end in base_spans(text))


def test_personal_data_in_odd_tables(spark):
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame([(None, "a@b.co a@b.co", "k"), (1, None, None), (1, None, None)], SCHEMA)
    rows = pii.redact(pii.find(frame.withColumn("spans", F.lit(1)))).collect()
    assert sorted(str(r["text"]) for r in rows) == ["None", "None", "[EMAIL] [EMAIL]"]


def plain_sets(text, words):
    found = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def test_shingle_sets_are_those_of_plain_words():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbÉé \t\n\x0b\xa0\x1c") for _ in range(rng.randrange(60))) for _ in range(500)] + [""]
    for words in (1, 3, 5):
        seen = {}
        for text, found in zip(texts, shingle_sets(texts, words)):
            want = plain_sets(text, words)
            assert len(found) == len(want)
            assert seen.setdefault(frozenset(want), found.tobytes()) == found.tobytes()


def edited(words, rng, share):
    return [rng.choice("uvwxyz") * rng.randrange(1, 9) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("words", [3, 5])
def test_components_equal_those_of_all_pairs(spark, words):
    rng = random.Random(words)
    texts = [None, "", " \n", "one two", "One  TWO", "one"]
    for group in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        texts += [" ".join(base)] * 3 + [" ".join(edited(base, rng, 0.012 * rng.randrange(4))) for _ in range(12)]
    passage = " ".join(f"p{k}" for k in range(50))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    rng.shuffle(texts)
    frame = spark.createDataFrame([(k * 3, t, "x") for k, t in enumerate(texts)], SCHEMA)
    sets = [plain_sets(t, words) for t in texts]
    links = [
        (3 * a, 3 * b)
        for a in range(len(texts))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = {3 * k: 3 * k for k in range(len(texts))} | labels(links)
    for rounds in (0, 2):
        rows = minhash.near_duplicates(frame, words, rounds=rounds).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
        assert {r["doc_id"]: r["n_shingles"] for r in rows} == {3 * k: len(s) for k, s in enumerate(sets)}


def test_near_duplicates_in_odd_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "a b c d e f g h"
    frame = spark.createDataFrame([(None, text, ""), (4, text, ""), (4, text, ""), (2, text + " i j k l", ""), (1, None, "")], SCHEMA)
    rows = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame).collect())
    assert rows == [(-1, None, True), (1, 1, True), (2, 2, True), (4, 4, True), (4, 4, True)]


def test_estimate_is_unbiased():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for overlap in (0.5, 0.8, 0.95):
        size = 900
        shared = int(size * 2 * overlap / (1 + overlap))
        low = minhash.minima([np.sort(pool[:size]), np.sort(pool[size - shared : 2 * size - shared])])
        same = ((low[0] ^ low[1]) & np.uint64(15) == 0).mean()
        assert abs((same - 1 / 16) / (15 / 16) - overlap) < 0.09


TEXTS = {
    "en": "the cat and the dog went to the house and then they had something with the other thing",
    "de": "der hund und die katze gingen nicht in das haus und dann war es schön über der straße",
    "fr": "le chat et le chien sont allés à la maison et puis ils étaient très près de la forêt",
}


def language_docs():
    rng = random.Random(7)
    rows = []
    for lang, text in TEXTS.items():
        words = text.split()
        rows += [(None, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40))), lang) for _ in range(80)]
    return [(k, text, lang) for k, (_, text, lang) in enumerate(rows)] + [(900, None, "en"), (901, "12 %%", None), (902, "", "de")]


def test_languages_of_held_out_texts(spark):
    frame = spark.createDataFrame(language_docs(), "doc_id long, text string, lang string")
    model = langid.train(frame.filter(~langid.held_out()))
    rows = langid.predict(frame.withColumn("score", F.lit("x")), model).withColumn("out", langid.held_out()).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] >= 900)
    held = [r for r in rows if r["out"] and r["doc_id"] < 900]
    assert len(held) > 40 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    # Code lengths equal those of the definition, byte by byte.
    for text in ("the über zebra Ω", "x", "straße"):
        assert model.code_lengths([text, "y"])[0].tolist() == pytest.approx(
            [plain_code_length(model, text, k) for k in range(len(model.languages))], rel=1e-5
        )


def test_a_tree_does_not_depend_on_other_languages(spark):
    rng = random.Random(5)
    common = ["".join(chr(rng.randrange(0x21, 0x7F)) for _ in range(9000)) for _ in range(40)]
    rare = [("xa", "qué cosa más rara es esta"), ("xb", "que coisa mais rara é esta")] * 2
    junk = [(f"junk{k}", f"text {k}") for k in range(1200)]
    schema = "lang string, text string"
    alone = langid.train(spark.createDataFrame(rare, schema))
    among = langid.train(spark.createDataFrame(rare + [("big", t) for t in common] + junk, schema))
    assert len(among.languages) == 1203
    own = [among.languages.index(lang) for lang in ("xa", "xb")]
    texts = ["qué cosa", "coisa rara", "other"]
    assert among.code_lengths(texts)[:, own].tolist() == alone.code_lengths(texts).tolist()


def test_languages_learn_from_so_many_rows(spark):
    rows = [("en", f"text number {k}") for k in range(2000)] + [("xx", f"rare {k}") for k in range(30)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    folder = langid.Folder(spark)
    drawn = {r["lang"]: r["count"] for r in langid.sample(frame, 200, folder).groupBy("lang").count().collect()}
    assert drawn["xx"] == 30 and 140 < drawn["en"] < 260
    few, all_ = langid.train(frame, 200), langid.train(frame, 2000)
    assert few.counts[0][2].sum() < 0.3 * all_.counts[0][2].sum() and few.languages == all_.languages


def plain_code_length(model, text, lang):
    tables = []
    for gram, language, n in model.counts:
        table = {}
        for g, count in zip(gram[language == lang].tolist(), n[language == lang].tolist()):
            table.setdefault(g >> 8, {})[g & 255] = count
        tables.append(table)
    data, total = b"\0\0\0" + text.encode(), 0.0
    for at in range(3, len(data)):
        for order in (3, 2, 1, 0):
            followers = tables[order].get(int.from_bytes(data[at - order : at], "big"))
            if not followers:
                continue
            both = sum(followers.values()) + len(followers)
            if data[at] in followers:
                total -= np.log(followers[data[at]] / both)
                break
            total -= np.log(len(followers) / both)
        else:
            total += np.log(256)
    return total


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    rows = langid.predict(frame, langid.train(frame)).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)] * 2
    assert langid.predict(frame.limit(0), langid.train(frame.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="login"><nav><ul><li><a href=/x>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>
<header>Site</header><article class="post"><header><h1>Head&nbsp;line</h1></header><p>One <b>bo</b>ld<br>two &lt;3 &amp &am<p>Three
  four<div class="comments">First!</div><form><input>mail</form></article>
<aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_tags_decide_what_they_can():
    kept = [text for text, state, _ in markup.blocks(PAGE) if state == markup.INSIDE]
    assert kept == ["Head line", "One bold", "two <3 & &am", "Three four"]
    assert [text for text, state, _ in markup.blocks(PAGE) if state == markup.OPEN] == []


def test_frames_do_not_swallow_articles():
    def kept(page):
        return [text for text, state, _ in markup.blocks(page) if state != markup.FRAMED]

    article, aside = "<article><p>One</p><form>mail</form></article>", "<aside><article>Teaser</article></aside>"
    assert kept(f"<form id=f><nav>Menu</nav>{article}{aside}</form>") == ["One"]
    assert kept(f"<div class='layout-with-sidebar'>{article}</div>") == ["One"]
    assert kept(f"<div class='menu'><div class='search'>{article}</div></div>") == ["One"]
    assert kept(f"<p class='ad'>Buy<div>{article}</div><p class=ad><b>Buy<div>Two</div>") == ["One", "Two"]
    assert kept("<form><nav>Menu</nav><div>One</div></form>") == ["One"]
    assert kept(f"{article}{aside}<div class='notice'>No</div>") == ["One"]
    assert kept(f"<div style='display:none'>{article}</div><div>Two</div>") == ["Two"]
    assert kept("<nav>Menu</nav><div class=ad>Buy</div>") == []


@pytest.mark.parametrize("page", ["", "<", "<p", "a<b>c", "<!-- x", "<script>x", "</p></div>", "<a href='x>y", "&#xD800;&#0;", "<p>" * 3000])
def test_broken_pages_do_not_fail(page):
    assert all(text == " ".join(text.split()) and text for text, _, _ in markup.blocks(page))


def test_repeats_decide_the_rest(spark):
    def page(k):
        return (f"<html><body><div>Home | News | Sports | Weather today | Contact us | Page {k}</div>"
                f"<div><p>Story number {k} tells of thing{k} and other{k} that nobody{k} has{k} ever{k} seen{k}.</p></div>"
                "<div>Read all about our rules of use and the data we keep here</div></body></html>")

    rows = [(k, f"https://h.example/{k}", page(k), "x") for k in range(5)]
    rows += [(10, "https://h.example/copy", page(0), "x"), (11, "https://other.example/", page(9), "x")]
    rows += [(12, None, None, None), (13, "https://h.example/e", "", ""), (None, "x", PAGE, ""), (14, "https://solo.example", PAGE, "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    story = "Story number {0} tells of thing{0} and other{0} that nobody{0} has{0} ever{0} seen{0}."
    assert all(got[k] == story.format(k) for k in range(5)) and got[10] == got[0]
    assert "Home |" in got[11] and got[11].endswith("keep here")
    assert got[12] == got[13] == "" and got[14] == got[None] == "Head line One bold two <3 & &am Three four"
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_only_repeated_runs_go_and_near_copies_are_one_page(spark):
    quote = "what was said by all of us at that time"
    own = ["Ann adds a thought", "Bob does not agree with any of that"]
    pages = [f"<div><p>{text} {quote} and {text.lower()}</p></div>" for text in own]
    story = " ".join(f"w{k}" for k in range(80))
    pages += [f"<div><p>{story}</p><p>Version {k}</p></div>" for k in range(3)]
    rows = [(k, f"https://h.example/{k}", page) for k, page in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(quote not in got[k] and text in got[k] and text.lower() in got[k] for k, text in enumerate(own))
    assert [got[k] for k in range(2, 5)] == [f"{story} Version {k}" for k in range(3)]


def plain_kept(streams, least):
    """What is left of each block: ``streams`` are lists of blocks of tokens, one for each page."""
    tokens = [[t for block in blocks for t in block] for blocks in streams]
    out = []
    for k, blocks in enumerate(streams):
        own, inside = tokens[k], set()
        for at in range(max(1, len(own) - least + 1)):
            prefix = own[at : at + least]
            others = (o for j, o in enumerate(tokens) if j != k)
            if any(prefix == o[i : i + least] for o in others for i in range(max(1, len(o) - least + 1))):
                inside.update(range(at, at + least))
        at, kept = 0, []
        for block in blocks:
            rest = [t for i, t in enumerate(block, at) if i not in inside]
            kept.append(" ".join(rest) if len(rest) == len(block) or len(rest) >= least else "")
            at += len(block)
        out.append(kept)
    return out


def random_streams(seed, n=25):
    rng = random.Random(seed)
    return [[[rng.choice("abc") for _ in range(rng.randrange(1, 14))] for _ in range(4)] for _ in range(n)]


@pytest.mark.parametrize("least", [3, 5])
def test_kept_runs_are_those_of_a_plain_search(spark, least):
    streams = random_streams(9)
    texts = ["\n".join(map(" ".join, blocks)) for blocks in streams]
    frame = spark.createDataFrame([("h", t, k) for k, t in enumerate(texts)], "host string, stream string, page long")
    keys = {bytes(r["key"]): r["stream"] for r in frame.withColumn("key", html_text.stream_key()).collect()}
    found = html_text.repeated_blocks(frame, html_text.Folder(spark), least).collect()
    got = {keys[bytes(r["key"])]: r["kept"] for r in found}
    for text, blocks, want in zip(texts, streams, plain_kept(streams, least)):
        assert got.get(text, [" ".join(block) for block in blocks]) == want


def test_intervals_go_on_over_the_ends_of_partitions(spark):
    streams = random_streams(33, 40) + [[["a"] * 400], [["a"] * 300, ["b"] * 5]]
    texts = ["\n".join(map(" ".join, blocks)) for blocks in streams]
    frame = spark.createDataFrame([("h", t, k) for k, t in enumerate(texts)], "host string, stream string, page long")
    keys = {bytes(r["key"]): r["stream"] for r in frame.withColumn("key", html_text.stream_key()).collect()}
    option, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(option, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = html_text.repeated_blocks(frame, html_text.Folder(spark), 4).collect()
    finally:
        spark.conf.unset(option)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {keys[bytes(r["key"])]: r["kept"] for r in found}
    for text, blocks, want in zip(texts, streams, plain_kept(streams, 4)):
        assert got.get(text, [" ".join(block) for block in blocks]) == want


@pytest.mark.parametrize("rows_a_batch", [1, 2, 7, 1000])
def test_intervals_of_sorted_suffixes(rows_a_batch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(rows_a_batch)
    tokens = sorted(rng.choice([1, 2, 3, 4, 5, 5, 5]) for _ in range(60))
    rows = [(np.array([9, t], ">u8").tobytes(), k, 0, 1, page, page) for k, t in enumerate(tokens) for page in [rng.randrange(2) if t > 2 else 0]]
    names = ["suffix", "stream", "at", "size", "low", "high"]
    types = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + rows_a_batch]), types)], names=names)
        for k in range(0, len(rows), rows_a_batch)
    ]
    got = {r["stream"]: r["suffix"] for batch in html_text.repeats_of(iter(batches)) for r in batch.to_pylist()}
    ends = {rows[0][0], rows[-1][0]}
    pages = {}
    for suffix, *_, page in rows:
        pages.setdefault(suffix, set()).add(page)
    want = {r[1]: r[0] if r[0] in ends else None for r in rows if r[0] in ends or len(pages[r[0]]) > 1}
    assert got == want and not list(html_text.repeats_of(iter([])))


def test_repeats_cross_elements_and_short_elements_go_whole(spark):
    def page(k, one, two):
        return f"<div class={one}>one two three four</div><p class={two}>five six seven own{k} words{k} go{k} on{k} for{k} long{k}</p><div id=s>Share this</div>"

    rows = [(k, f"https://h.example/{k}", page(k, f"c{k}", f"d{k}")) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(3)] == [f"own{k} words{k} go{k} on{k} for{k} long{k}" for k in range(3)]


def test_whole_pages_without_tags_equal_a_plain_search(spark):
    streams = random_streams(21)
    pages = ["<html><body>" + "".join(f"<div>{' '.join(block)}</div>" for block in blocks) + "</body></html>" for blocks in streams]
    frame = spark.createDataFrame([(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    for k, want in enumerate(plain_kept(streams, html_text.LEAST_TOKENS)):
        left = " ".join(filter(None, want))
        assert got[k] == (left or " ".join(t for block in streams[k] for t in block))


def test_long_shared_streams_cost_what_their_tokens_do(spark):
    shared = " ".join(f"w{k}" for k in range(3000))
    pages = [f"<div><p>{shared}</p><p>{' '.join(f'own{k}x{i}' for i in range(1500))}</p></div>" for k in range(4)]
    frame = spark.createDataFrame([(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    assert all(got[k] == " ".join(f"own{k}x{i}" for i in range(1500)) for k in range(4))


def test_digest_columns_follow_from_the_spans():
    text = "mail a@b.co from 1.2.3.4"
    assert pii_names(text) == "email:5:11,ip:17:24"
    assert len(hashlib.sha256(pii_names(text).encode()).hexdigest()) == 64
