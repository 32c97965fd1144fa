import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import bloomlm, chat, common, components, decontaminate, kdshard, licenses, mixing, mpegts, neardup, quality, queries, wrappers
from framewright.llm.textkernel import SPACE, hash_words, shingles, text_slices, tokenize
from tests.compare import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, small, name):
    same(queries.queries()[name](spark, small), connect(small), queries.oracle_sql()[name])


# 1


@pytest.mark.parametrize("unit", [191, 192, 383, 9216])
def test_transport_stream_round_trip(unit):
    rng = np.random.default_rng(unit)
    for n in [0, 1, 160, 170, 176, 184, 191, 192, 193, 400, 9216, 9217, 40000]:
        payload = mpegts.padded(rng.bytes(n))
        s = mpegts.demultiplex(mpegts.multiplex(payload, unit))
        assert s.payload == payload and len(payload) % 192 == 0 and len(payload) >= 192
        assert (s.continuity_errors, s.table_errors, s.sync_errors) == (0, 0, 0)
        assert s.programs == {1: {256: 6}} and s.pts == [k * mpegts.TICKS for k in range(-(-len(payload) // unit))]
        assert s.random_access == list(range(0, len(s.pts), mpegts.RAP_EVERY))


def test_transport_stream_faults_are_counted():
    media = mpegts.multiplex(bytes(range(192)) * 100)
    lost = media[: 188 * 10] + media[188 * 11 :]
    assert mpegts.demultiplex(lost).continuity_errors == 1
    assert mpegts.demultiplex(media[:-5]).sync_errors == 1
    broken = bytearray(media)
    broken[20] ^= 1
    assert mpegts.demultiplex(bytes(broken)).table_errors == 1
    assert mpegts.demultiplex(b"").payload == b""


def test_legal_repeats_jumps_and_long_tables():
    media = mpegts.multiplex(bytes(range(192)) * 500)
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    whole = mpegts.demultiplex(media)
    for k in (2, 5, len(packets) - 1):  # a packet may come twice, but not three times
        twice = mpegts.demultiplex(b"".join([*packets[: k + 1], *packets[k:]]))
        assert (twice.payload, twice.pts, twice.continuity_errors) == (whole.payload, whole.pts, 0)
        assert mpegts.demultiplex(b"".join([*packets[: k + 1], packets[k], *packets[k:]])).continuity_errors == 1
    starts = [k for k, p in enumerate(packets) if k > 2 and p[1] & 0x40 and p[3] & 0x20]
    jump = [bytearray(p) for p in packets]
    for p in jump[starts[0] :]:
        p[3] = p[3] & 0xF0 | (p[3] + 5) & 15
    assert mpegts.demultiplex(b"".join(jump)).continuity_errors == 1
    jump[starts[0]][5] |= 0x80
    assert mpegts.demultiplex(b"".join(jump)).continuity_errors == 0
    entries = b"".join((0x06).to_bytes(1, "big") + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00" for pid in [0x100, *range(0x200, 0x250)])
    body = (0xE100).to_bytes(2, "big") + b"\xf0\x00" + entries
    section = bytes([2]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + body
    section += mpegts.crc32_mpeg(section).to_bytes(4, "big")
    table, rest = [], b"\x00" + section
    for k in range(0, len(rest), 184):
        table.append((bytes([0x47]) + ((0x5000 if k == 0 else 0x1000)).to_bytes(2, "big") + bytes([0x10 | k // 184 & 15]) + rest[k : k + 184]).ljust(188, b"\xff"))
    long = mpegts.demultiplex(b"".join([packets[0], *table, *packets[2:]]))
    assert len(table) > 1 and long.table_errors == 0 and len(long.programs[1]) == 81 and long.payload == whole.payload
    assert mpegts.demultiplex(b"".join([packets[0], *table[:-1], *packets[2:]])).table_errors == 1


def test_media_features(docs, none):
    for r in mpegts.media_features(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    for r in mpegts.media_features(docs).collect():
        assert r.pts == [k * mpegts.TICKS for k in range(len(r.pts))] and r.random_access == list(range(0, len(r.pts), mpegts.RAP_EVERY)) and f"units={len(r.pts)} " in r.feature
    assert mpegts.media_features(docs).count() == docs.count() and mpegts.media_features(none).count() == 0


# 2


def test_water_filling_keeps_caps_and_total():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        sizes, weights = rng.integers(0, 1000, n).tolist(), rng.integers(1, 6, n).tolist()
        t = mixing.water_fill(sizes, weights, 1.5 * sum(sizes), 2)
        assert all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes)) and math.isclose(sum(t), 1.5 * sum(sizes), abs_tol=1e-6)
        free = [x / w for x, w, s in zip(t, weights, sizes) if x < 2 * s - 1e-6]
        assert not free or max(free) - min(free) < 1e-6


def test_mix_meets_targets(docs, none):
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == docs.count() and mixing.mix_documents(none).count() == 0
    assert rows and sorted(map(str, rows)) == sorted(map(str, mixing.mix_documents(docs.repartition(5)).collect()))
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    key = lambda r: (r.source_size, r.target)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, sizes, targets = Counter(), Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r["size"]
        targets.setdefault(source[r.doc_id], set()).add(key(r))
    for name, n in taken.items():
        ((size, target),) = targets[name]
        assert size == sizes[name] and abs(n - target) <= 0.5 and target <= 2 * size
    assert math.isclose(sum(t for ((_, t),) in targets.values()), 1.5 * sum(sizes.values()), abs_tol=1e-3)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_any_number_of_sources_is_mixed(spark, monkeypatch, bound):
    monkeypatch.setattr(mixing, "MAX_BROADCAST", bound)
    rng = np.random.default_rng(22)
    names = [None, *[f"s{i}" for i in range(700)]]
    rows = [(i, names[int(rng.integers(len(names)))], int(rng.integers(0, 40))) for i in range(3000)] + [(7, "s3", 11)] * 40 + [(None, None, 5)] * 30
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, source string, n long, mix_words string, mix_part int, mix_row double")
    out = mixing.mix(df, F.col("n"), per_bucket=16)
    got = out.select("mix_row.*", F.col("mix_taken").alias("taken"), F.col("mix_target").alias("target"), F.col("mix_words").alias("words")).collect()
    assert len(got) == len(rows) and all(r.mix_part == 1 and 0 <= r.taken <= 2 * r.n for r in got)
    sizes = Counter()
    for _, name, n in rows:
        sizes[name] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, mixing.water_fill([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()), 2.0)))
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, want[r.source], abs_tol=2e-6)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)


def test_the_mix_has_the_taken_words(docs):
    want = sum(r.taken for r in mixing.mix_documents(docs).collect())
    mixed = mixing.repeated(docs)
    assert mixed.columns == docs.columns and {r["size"] for r in mixed.collect()} == {"big"}
    assert mixing.repeated(docs.withColumn("target", F.lit(9)).withColumn("mix_row", F.lit(8))).count() == mixed.count()
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == want


# 3


def test_extraction_of_a_full_page(spark):
    html = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='<p>x</p>';</script></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><main><article><h1>Caf&eacute;  &amp; co</h1><p>One <b>two</b>\n three<p>Four&#x21;<div class='ad-box'>Buy</div>"
        "<blockquote>Quote</blockquote><form>Name <input></form></article><section id='comments'><p>First!</p></section></main><aside>Side</aside><footer>&copy;</footer></body></html>"
    )
    assert wrappers.main_text(html) == "Café & co\nOne two three\nFour!\nQuote"
    pages = [(1, "http://h/1", html), (2, None, None), (3, "http://h/3", ""), (4, "x", "plain text only"), (1, "http://h/1", html), (5, "http://h/5", "<div class=content><p>A</p><p>B<br>C</div><p>after")]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")).collect()}
    assert got[1].text.startswith("Café") and got[2].text == "" and got[3].n_chars == 0 and got[4].text == "plain text only"
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_and_deep_markup():
    deep = "<article>" + "<div><p>a" * 3000 + "</div>" * 3000 + "<p>end</article><footer>x</footer>"
    assert wrappers.main_text(deep).endswith("a\nend") and len(str(wrappers.folded(wrappers.parse(deep)))) > 0
    assert wrappers.main_text("<body><p class='it's'>one</p><p title=\"a>b\">two</p><p x=\"y>three</p> a < b <b>c") == "one\ntwo\nthree\na < b c"
    assert wrappers.main_text("<p " + 'a="b" ' * 20000) == "" and wrappers.main_text("&" * 1000) == "&" * 1000


def test_wrappers_align_into_groups():
    def page(body):
        return wrappers.folded(wrappers.parse(f"<body>{body}</body>"))

    w = wrappers.merge(page("<h1>a</h1><p>b</p>"), page("<h1>a</h1><p>b</p><p>c</p><div>d</div>"))
    assert str(w) == "<page><body><h1>#text</h1>(<p>#text</p>)+(<div>#text</div>)?</body></page>"
    assert wrappers.read_wrapper(str(w)) == w


def test_wrappers_match_all_their_pages():
    rng = np.random.default_rng(3)

    def body(depth):
        return "".join(
            "text " if rng.random() < 0.2 else f"<{tag}{' class=' + str(rng.choice(list('xyz'))) if rng.random() < 0.3 else ''}>{body(depth - 1) if depth else 'leaf'}</{tag}>"
            for tag in rng.choice(["div", "section", "h2", "ul", "table", "b"], int(rng.integers(0, 7)))
        )

    for _ in range(60):
        pages = [wrappers.parse(f"<body>{body(2)}</body>") for _ in range(8)]
        wrapper = wrappers.folded(pages[0])
        for p in pages[1:]:
            wrapper = wrappers.merge(wrapper, wrappers.folded(p))
        assert wrappers.read_wrapper(str(wrapper)) is wrapper or str(wrappers.read_wrapper(str(wrapper))) == str(wrapper)
        assert all(wrappers.accepts(str(wrapper), p) for p in pages)
    assert not wrappers.accepts("<page><body><h1>#text</h1>(<p>#text</p>)+</body></page>", wrappers.parse("<body><p>x</p><h1>y</h1></body>"))
    rows = [[f"<p class=c{'abcdefgh'[int(k)]}>x</p>" for k in rng.integers(0, 8, 400)] for _ in range(3)]
    pages = [wrappers.parse("".join(r)) for r in rows]
    wrapper = wrappers.merge(wrappers.merge(*map(wrappers.folded, pages[:2])), wrappers.folded(pages[2]))
    assert all(wrappers.accepts(str(wrapper), p) for p in pages)


def test_chrome_is_told_at_any_depth_and_not_by_an_articles_own_names(spark):
    own = (
        '<article><h1>Title</h1><h2 id="search-algorithms">Search</h2><p>x</p><h2 id="related-work">Related</h2><p class="side-note">kept?</p><p id="reply">r</p>'
        '<p class="ad">Buy</p><div class="share-buttons social">Share</div><div id="comments"><p>First</p></div><p>y <span class="advert">Now</span>z</p></article>'
    )
    assert wrappers.main_text(own) == "Title\nSearch\nx\nRelated\nkept?\nr\ny z"
    assert wrappers.main_text("<div>" * 230 + "<nav>menu</nav><p>text</p>" + "<div>" * 3000 + "deep" + "<aside>side</aside>") == "text\ndeep"
    assert wrappers.main_text("<div class='with-sidebar'><article><p>a</p></article><div class=sidebar>b</div></div>") == "a"
    siblings = "".join(f"<p class=c{'abcdefg'[i * i % 7]}>p{i}</p>" for i in range(500))
    assert wrappers.main_text(f"<article>{siblings}</article>") == "\n".join(f"p{i}" for i in range(500))


def test_constants_go_by_slots_not_by_paths(spark):
    pages = [(i, f"http://h/{i}", f"<body><div>Top line</div><div><p>Story {i}</p></div><div>Story {i} ends</div><b>Bottom</b></body>") for i in range(5)]
    pages += [(10 + i, f"http://g/{i}", f"<article><p>Same opening</p><h2>One</h2><p>Story {i}</p></article>") for i in range(5)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith("Top line\nStory") or got[i].startswith("Story") for i in range(5)) and all(got[10 + i] == f"Same opening\nOne\nStory {i}" for i in range(5))


def test_constants_of_a_host_are_dropped(spark):
    pages = [(i, f"http://h/{i}", f"<article><p>Story {i} text</p><div>Read more stories</div></article>") for i in range(4)]
    got = wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Story {r.page_id} text" for r in got)


def test_copies_and_own_headings_keep_their_text(spark):
    copies = [(i, f"http://h/{i}", f"<div class=promo{i}>Offer {i}</div><article><p>Copied</p><ul><li>one</li><li>two</li></ul></article>") for i in range(4)]
    others = [(10 + i, f"http://h/{10 + i}", f"<article><p>Story {i}</p>{'<h2>Summary</h2><blockquote>Said</blockquote>' if i < 4 else ''}</article>") for i in range(12)]
    headed = [(30 + i, f"http://g/{i}", f"<article><h2>Summary</h2><p>Story {i}</p><div>Read more</div></article>") for i in range(5)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(copies + others + headed, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(4)} == {"Copied\none\ntwo"}
    assert all(got[10 + i] == f"Story {i}" + ("\nSummary\nSaid" if i < 4 else "") for i in range(12))
    assert all(got[30 + i] == f"Summary\nStory {i}" for i in range(5))


# 4


def test_quality_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    r = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").select((F.col("predicted") == F.col("quality")).cast("int").alias("ok")).agg(F.avg("ok"), F.count("*")).first()
    assert r[0] > 0.97 and r[1] > 500


def test_quality_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0), (8, None, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.classify(none, labels).count() == 0
    assert all(r.score == 0.5 for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.keep_good(docs, labels).columns == docs.columns
    held = {r.doc_id: r.held_out for r in rows}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in held.items() if k is not None)


def test_repeated_rows_of_a_labelled_id_are_learnt_once(spark):
    texts = {i: f"some text number {i} " * (i % 7 + 1) for i in range(40)}
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    rows = [(i, t) for i, t in texts.items()]
    schema = "doc_id long, text string"
    once, often = (spark.createDataFrame(r, schema) for r in (rows, rows + [rows[1]] * 300))
    a, b = quality.fit(once, labels), quality.fit(often, labels)
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables))


# 5


def test_license_filters_lose_nothing():
    rng = np.random.default_rng(5)
    words = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()})
    scanner = licenses.Scanner(licenses.ordered_templates(licenses.TEMPLATES, 0.8, {}))
    lines = []
    for t in list(licenses.TEMPLATES.values()) * 4:
        kept = [w for w in t.split() if rng.random() < 0.85]
        lines.append(" ".join(rng.permutation([*kept, *rng.choice(words, 3)])))
    _, _, data, off = next(text_slices(pa.array(["\n".join(lines), *lines])))
    for d, _, _, met in scanner.scan(data, off):
        blocks = lines if d == 0 else [lines[d - 1]]
        want = {}
        for i, t in enumerate(scanner.templates):
            tokens = set(licenses.TEMPLATES[t.label].split())
            best = max(len(tokens & set(b.split())) / len(tokens) for b in blocks)
            if best >= 0.8:
                want[i] = best
        assert met == pytest.approx(want)


def test_license_filters_only_spare_comparisons():
    rng = np.random.default_rng(55)
    tables = {**licenses.TEMPLATES, **licenses.NOTICES}
    words = sorted({w for t in tables.values() for w in t.split()})
    frequency = {int(h): int(n) for h, n in zip(licenses.hash_words(words), rng.integers(0, 50, len(words)))}
    templates = licenses.ordered_templates(licenses.TEMPLATES, 0.8, frequency, licenses.NOTICES)
    blocks = [[int(h) for h in licenses.hash_words([w for w in t.split() if rng.random() < 0.8] + list(rng.choice(words, 12)) + ["other"] * 3)] for t in list(tables.values()) * 6]
    every, scanners = ("prefix", "length", "position"), {}
    for filters in [every, *(tuple(f for f in every if f != left) for left in every), ()]:
        scanners[filters] = licenses.Scanner(templates, frequency, filters)
        got = [scanners[filters].block(b) for b in blocks]
        want = [{i: n for i, t in enumerate(templates) if (n := len(set(b) & set(t.tokens))) >= t.need} for b in blocks]
        assert got == want
    counts = {f: s.candidates for f, s in scanners.items()}
    assert counts[every] < counts["prefix", "length"] < counts[()] and counts[every] <= min(counts["length", "position"], counts["prefix", "position"])


def test_whole_notices_are_met_in_paragraphs(spark):
    notice = licenses.NOTICES["isc-text"].split()
    wrapped = "\n".join(" ".join([*notice[k : k + 6], "four", "more", "words", "inserted"]) for k in range(0, len(notice), 6))
    texts = [(1, f"Before it\n\n{wrapped}\n \t\nafter"), (2, wrapped.replace("inserted\n", "inserted\n\n")), (3, "use copy modify"), (4, wrapped + "\n"), (5, "\n" + wrapped)]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "isc-text", 2: "", 3: "", 4: "isc-text", 5: "isc-text"}


def test_wrapped_notices_are_met():
    scanner = licenses.Scanner(licenses.ordered_templates(licenses.TEMPLATES, 0.8, {}))
    texts, want = [], []
    for i, t in enumerate(licenses.TEMPLATES.values()):
        words = t.split()
        for width in (3, 7):
            texts.append("before it\n" + "\n * ".join(" ".join(words[k : k + width]) for k in range(0, len(words), width)) + "\nafter it")
            want.append(i)
    for width in (2, 4):
        notice = licenses.TEMPLATES["bsd"].split()
        texts += ["\n\n".join(notice[:width]), "\n".join(" ".join(notice[k : k + 2]) + "\nother words" for k in range(0, len(notice), 2))]
        want += [None, None]
    _, _, data, off = next(text_slices(pa.array(texts)))
    for d, _, _, met in scanner.scan(data, off):
        assert met == {} if want[d] is None else met[want[d]] == 1.0


def test_license_edge_cases(docs, none):
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert rows[10].base_labels == "cc-by-nc,mit" and rows[10].n_base == 3 and rows[10].first_word == 1 and rows[10].score == 1.0
    assert rows[3].n_words == 0 and rows[3].first_word is None and rows[4].labels == ""
    assert licenses.scan_licenses(none).count() == 0


# 6


def test_language_model(docs, none):
    rows = bloomlm.score_documents(docs).collect()
    texts = [(r.doc_id, WORD.findall(low(r.text)) + [None]) for r in docs.collect()]
    train = Counter(w for i, ws in texts if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, d = sum(train.values()), sum(train.values()) + 0.5 * (len(train) + 1)
    want = sorted((len(ws), sum(train[w] > 0 for w in ws), total, round(sum(math.log10((train[w] + 0.5) / d) for w in ws), 6)) for _, ws in texts)
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows) and bloomlm.score_documents(none).count() == 0


def test_bloom_levels_have_no_false_negatives():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    levels = rng.integers(0, 9, 4000)
    f = bloomlm.Filter(np.zeros(4 * (1 << 16) // 8, np.uint8), 4, 1 << 16)
    f.insert(keys, levels)
    got = f.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.9
    other = f.levels(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    assert (other == 0).mean() > 0.9


@pytest.mark.parametrize("bound", [1 << 29, 0])
def test_filter_grows_with_its_levels(spark, monkeypatch, bound):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 400) % 50000)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in bloomlm.score_documents(docs).collect()}
    monkeypatch.setattr(bloomlm, "MAX_BITS", bound)
    monkeypatch.setattr(bloomlm, "PART_BYTES", 1 << 16)
    model, _, segments, parts = bloomlm.fit(docs)
    assert parts >= 8 and (model.filter is None) == (bound == 0)
    for r in segments.collect():
        assert np.unpackbits(np.frombuffer(r.segment, np.uint8)).mean() < 0.35
    got = {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in bloomlm.score_documents(docs).collect()}
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert max(abs(got[i][2] - want[i][2]) for i in want) < 0.02 * max(abs(x[2]) for x in want.values())


def test_dealt_answers_equal_the_broadcast_filter(docs, none, monkeypatch):
    monkeypatch.setattr(bloomlm, "PART_BYTES", 1 << 14)
    want = sorted(map(repr, bloomlm.score_documents(docs).collect()))
    monkeypatch.setattr(bloomlm, "MAX_BITS", 0)
    assert sorted(map(repr, bloomlm.score_documents(docs).collect())) == want
    assert bloomlm.score_documents(none).count() == 0


def zipf_docs(spark, n=150):
    rng = np.random.default_rng(16)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.4, 300) % 3000)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def exact_model(rows):
    train = [[None, *WORD.findall(low(t)), None] for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    return Counter(w for ws in train for w in ws[1:]), Counter(p for ws in train for p in zip(ws, ws[1:]))


@pytest.mark.parametrize("bound", [1 << 29, 0])
def test_scores_against_exact_counts(spark, monkeypatch, bound):
    monkeypatch.setattr(bloomlm, "MAX_BITS", bound)
    fitted = []
    monkeypatch.setattr(bloomlm, "fitted_weights", lambda h, fit=bloomlm.fitted_weights: fitted.append(fit(h)) or fitted[-1])
    rows, docs = zipf_docs(spark)
    ones, twos = exact_model(rows)
    got = {r.doc_id: r for r in bloomlm.score_documents(docs).collect()}
    denominator, (weights,) = sum(ones.values()) + 0.5 * (len(ones) + 1), fitted
    for i, text in rows:
        ws, exact = [None, *WORD.findall(low(text)), None], 0.0
        for v, w in zip(ws, ws[1:]):
            lam = weights[int(math.log2(ones[v]))] if ones[v] else 0.0
            exact += math.log10((1 - lam) * (ones[w] + 0.5) / denominator + lam * twos[v, w] / max(1, ones[v]))
        assert exact - math.log10(2) * got[i].n_tokens <= got[i].score <= exact + 0.05 * got[i].n_tokens, i


def test_estimates_after_a_word_sum_to_at_most_one_and_weights_are_likeliest(spark):
    rows, docs = zipf_docs(spark)
    ones, twos = exact_model(rows)
    model = bloomlm.fit(docs)[0]
    histogram = bloomlm.histogram_of(docs.select("doc_id", (~bloomlm.learnt()).alias("held_out"), "text"), spark.sparkContext.broadcast(model), None)
    assert histogram.sum() == sum(n for (v, _), n in twos.items() if ones[v] >= 2)
    model.weights = bloomlm.fitted_weights(histogram)
    vocabulary = [w for w in ones if w is not None]
    for v in [vocabulary[0], vocabulary[50], vocabulary[-1]]:
        h = np.concatenate([[x, y] for x, y in zip(np.repeat(hash_words([v]), len(vocabulary)), hash_words(vocabulary))]).astype(np.uint64)
        c = bloomlm.count_tokens(model, h, np.arange(0, len(h) + 1, 2))
        at = np.arange(1, len(h), 2)
        lam = model.weights[bloomlm.level_of(c.history[at])]
        seen = np.array([twos[v, w] > 0 for w in vocabulary])
        alone, after = (1 - lam) * (c.word[at] + 0.5) / model.denominator, lam * c.pair[at] / c.history[at]
        assert alone.sum() + after[seen].sum() <= 1 and (after[~seen] > 0).mean() < 0.05
    width = histogram.shape[1]
    ratio = np.concatenate([[0.0], 2.0 ** ((np.arange(width - 1) - (width - 1) // 2 + 0.5) / bloomlm.RATIO_BINS)])
    level = int(histogram.sum(1).argmax())
    likelihood = lambda w: (histogram[level] * np.log(1 - w + w * ratio)).sum()
    best = max(likelihood(w) for w in np.linspace(0.01, 0.99, 99))
    assert likelihood(model.weights[level]) >= best - 0.01 * abs(best)


@pytest.mark.parametrize("bound", [1 << 29, 0])
def test_a_pair_seen_once_scores_above_an_unseen_one(spark, monkeypatch, bound):
    monkeypatch.setattr(bloomlm, "MAX_BITS", bound)
    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(i, " ".join(f"v{i}x{k}" for k in range(20))) for i in ids] + [(held, f"v{ids[0]}x3 v{ids[0]}x4"), (held, f"v{ids[0]}x3 v{ids[1]}x9")]
    got = bloomlm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter(F.col("doc_id") == held).collect()
    seen, unseen = sorted((r.score for r in got), reverse=True)
    assert seen > unseen + 1


# 7


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)]


def leak(text, item):
    clean = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))
    words, target = clean(text), clean(item)
    best = None
    goal = Counter(grams(target)) if target else None
    for at in range(len(words) - len(target) + 1 if target else 0):
        own = Counter(grams(words[at : at + len(target)]))
        s = sum((own & goal).values()) / sum((own | goal).values())
        if s >= 0.8 - 1e-12 and (best is None or s > best[0] + 1e-12):
            best = (s, at)
    return best


def test_multi_index_finds_all_within_the_radius_from_fewer_candidates():
    rng = np.random.default_rng(7)
    own = rng.integers(0, 256, (1500, 32), dtype=np.uint8)
    bits = np.unpackbits(own[:400], axis=1)
    for row in bits:
        row[rng.permutation(256)[: int(rng.integers(0, 90))]] ^= 1
    asked = np.packbits(bits, axis=1)
    index = decontaminate.MultiIndex(own)
    apart = np.bitwise_count(asked.view(np.uint64)[:, None, :] ^ own.view(np.uint64)[None]).sum(2)
    want = {(w, i): apart[w, i] for w, i in zip(*map(np.ndarray.tolist, np.nonzero(apart <= decontaminate.RADIUS)))}
    w, i, d = index.lookup(asked)
    assert dict(zip(zip(w.tolist(), i.tolist()), d.tolist())) == want and len(want) > 200
    assert len(want) < len(index.candidates(asked)[0]) < apart.size / 4


def test_leaks_against_brute_force(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()] + [(900, "one two three"), (901, None), (902, ""), (903, "one two three")]
    rng = np.random.default_rng(2)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()] + ["so ONE two, three.", "one two"]
    for _, t in items[:40]:
        w = t.split()
        for k in range(3):
            v = list(w)
            for _ in range(k):
                v[int(rng.integers(len(v)))] = "changed"
            texts.append("before it " + " ".join(v) + " and after")
        texts.append(" ".join(w[:-2]))
        texts.append(" ".join(w + w))
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "x one two three", 1), (5000, None, 1), (5001, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 6), r.start_word) for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {(d, i): (round(b[0], 6), b[1]) for d, t, _ in rows for i, x in items if (b := leak(t or "", x or ""))}
    assert got == want
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_documents_shorter_than_an_item_leak_it(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()] + [(900, "one two three"), (901, "a b c d e f")]
    clean = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))
    texts = [" ".join(t.split()[a:b]) for _, t in items[:40] for a, b in ((0, -1), (0, -2), (1, None), (0, -9), (3, -3))] + ["one two", "a b c d e", "b c d e"]
    want = {}
    for d, text in enumerate(texts):
        for i, item in items:
            own, target = Counter(grams(clean(text))), Counter(grams(clean(item)))
            if len(clean(text)) < len(clean(item)) and (s := sum((own & target).values()) / sum((own | target).values())) >= 0.8 - 1e-12:
                want[d, i] = (round(s, 6), 0, len(clean(text)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 6), r.start_word, r.n_words) for r in decontaminate.find_all_leaks(docs, bench).collect()}
    assert len(want) > 100 and got == want
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench, short=True).collect()} == set(range(len(texts))) - {d for d, _ in want}


# 8


def brute_components(texts):
    sets = {}
    for i, t in texts:
        words = WORD.findall(low(t))
        s = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
        sets[i] = s
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("blocks", [(512, 2048, 4096, 1 << 20, 16 << 20, 64, 16), (4, 3, 5, 2, 1 << 20, 2, 16), (4, 3, 500, 2, 600, 1, None)])
def test_components_against_brute_force(spark, monkeypatch, blocks):
    *blocks, keys = blocks
    for name, value in zip(("BLOCK", "WIDE_BLOCK", "EXACT_BLOCK", "MAX_BROADCAST_IDS", "EXACT_BYTES", "LEADS"), blocks):
        monkeypatch.setattr(neardup, name, value)
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for g in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(3, 120))))
        if g % 3 == 0:
            base = base + passage
        for _ in range(int(rng.integers(1, 14))):
            v = list(base)
            for _ in range(int(rng.integers(0, 4))):
                v[int(rng.integers(len(v)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(v))
    texts += ["", None, " \t", "One two", "one  TWO"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(df, keys).collect()}
    want = brute_components(rows)
    assert got == want
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


@pytest.mark.parametrize("wide", [3, 2048])
def test_only_sets_that_could_link_another_group_are_dealt(spark, monkeypatch, wide):
    monkeypatch.setattr(neardup, "WIDE_BLOCK", wide)
    rng = np.random.default_rng(11)
    sizes = [4, 5, 1024, 1280, 64, 81, *(int(x) for x in np.exp(rng.uniform(0, 9, 60)))]
    members = [(7, i, n) for i, n in enumerate(sizes)] + [(9, i, 10 * 2**i) for i in range(8)] + [(8, 0, 4), (8, 1, 5)]
    group = {i: i // 2 * 2 if i >= 8 else i for i in range(len(sizes))} | {1: 0}
    df = spark.createDataFrame(members, "key long, node long, n long").withColumns({"held": F.lit(1), "lead": F.lit(0)})
    coarse = spark.createDataFrame([(i, c) for i, c in group.items() if i % 3], "node long, component long")
    label = {i: c if i % 3 else i for i, c in group.items()}
    rest = neardup._open_members(df, coarse).collect()
    met = {}
    for r in rest:
        met.setdefault(r.key, []).append(r)
        assert r.component == label[r.node]
    assert all(r.held == len(met[r.key]) for r in rest)
    together = {(a.node, b.node) for rows in met.values() for a in rows for b in rows}
    want = {(i, j) for k, i, n in members for q, j, m in members if k == q and label[i] != label[j] and 100 * n >= 80 * m and 100 * m >= 80 * n}
    assert want and want <= together
    assert not met.keys() & {8, 9} and (wide == 3 or set(met) == {7})


def test_bands_hold_all_sizes_that_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        rows = [(i, int(n)) for i, n in enumerate(np.exp(rng.uniform(0, float(rng.uniform(0.1, 9)), int(rng.integers(1, 40)))))]
        bands = list(neardup._size_bands(rows))
        together = {(a, b) for band in bands for a in band for b in band}
        assert {(a, b) for a in rows for b in rows if 100 * a[1] >= 80 * b[1] and 100 * b[1] >= 80 * a[1]} <= together
        assert all(2 * min(r[1] for r in band) > max(r[1] for r in band) for band in bands)


def test_second_round_in_slices_finds_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 40, dtype=np.uint64)) for _ in range(30)]
    rows = [(i, 40, bytes(neardup.bitmap(sets[i // 4], 256))) for i in range(120)]
    maps = spark.createDataFrame(rows, "node long, n long, map binary")
    rest = spark.createDataFrame([(i // 8, i, 40, i, 8) for i in range(120)], "key long, node long, n long, component long, held long")
    steps = []
    monkeypatch.setattr(neardup, "checkpointed", lambda df: steps.append(1) or common.checkpointed(df))
    whole = {tuple(r) for r in neardup._second_pairs(rest, maps).collect()}
    assert len(steps) == 1 and len(whole) >= 90
    monkeypatch.setattr(neardup, "SLICE_BYTES", 1200)
    monkeypatch.setattr(neardup, "SLICE_MAPS", 0)
    assert {tuple(r) for r in neardup._second_pairs(rest, maps).collect()} == whole and len(steps) == 1 + 11


@pytest.mark.parametrize("most", [2, 1 << 19])
def test_kept_documents_are_not_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "MAX_BROADCAST_IDS", most)
    texts = [f"w{i} " * 3 + " ".join(f"t{i}x{j}" for j in range(40)) for i in range(400)]
    rows = [(2 * i + k, t) for i, t in enumerate(texts) for k in range(1 + (i < 20))]
    docs = spark.createDataFrame([*rows, rows[0], rows[500 % len(rows)], (None, "a b")], "doc_id long, text string").repartition(3).cache()
    docs.count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = neardup.keep_one(docs)
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2 * i for i in range(400)]
        assert kept.filter("doc_id IS NULL").count() == 1
        kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (most == 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        docs.unpersist()


def test_only_texts_of_cells_are_shuffled_to_them(spark):
    rows = spark.range(60_000).select(F.col("id").alias("node"), F.concat(F.lit("text "), "id").alias("text")).unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS node, 'none' AS text"))
    cells = spark.range(0, 60_000, 20).withColumnRenamed("id", "node")
    passed = {r.node: r.text for r in neardup._passed(rows, cells, 3000).collect()}
    assert set(range(0, 60_000, 20)) <= set(passed) and len(passed) < 8000 and all(t == f"text {i}" for i, t in passed.items())


def test_finished_steps_leave_no_shuffle_files(spark, monkeypatch):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    data = lambda: sum(f.getName().startswith("shuffle_") for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles()))
    monkeypatch.setattr(common, "TIDY_S", 0.0)
    common.checkpointed(spark.range(100_000).repartition(7, "id")).count()
    held = data()
    assert held >= 7
    common.tidy(spark)
    for _ in range(50):
        if data() < held:
            break
        time.sleep(0.2)
    assert data() < held


def test_component_edge_cases(docs, none):
    got = neardup.components(docs).collect()
    assert len(got) == docs.count() and neardup.components(none).count() == 0
    by = {r.doc_id: r.component_id for r in got}
    assert by[2] == 1 and by[9] == 8 and by[7] == 6 and by[3] == 3 and by[None] is None
    kept = neardup.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14] and sum(r.doc_id is None for r in kept) == 1


def test_prefix_keys_meet_for_every_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = a.copy()
        k = int(rng.integers(0, max(1, len(a) // 9 + 1)))
        if k:
            b = np.unique(np.concatenate([b[rng.permutation(len(b))[k:]], rng.integers(0, 2**63, k, dtype=np.uint64)]))
        common = np.sort(rng.choice(a, int(rng.integers(0, len(a) + 1)), replace=False))
        if neardup.linked(a, b):
            assert len(np.intersect1d(neardup.set_keys(a, common), neardup.set_keys(b, common)))


def test_connected_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# 9


def test_chat_round_trip_and_states(spark):
    pattern = chat.INSTRUCT.pattern()
    for text in ["</s>[INST] ok [/INST]", "a\\b", "\\", "<\\s>", "[INST[INST]]", " [/INST]", "</s", "<<SYS>>", "x\ny", "", None]:
        for role in ["user", "assistant", "system", "tool\nx", "", None]:
            formatted = "".join(s for s, _ in chat.segments(role, text, chat.INSTRUCT, pattern))
            assert chat.parse(formatted, chat.INSTRUCT)[0] == [(role or "", text or "", role == "assistant")]
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (3, 0, "user", "b"), (None, 0, None, None), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "y"), (4, 2, "assistant", "y")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, state string")
    got = {r.conv_id: r for r in chat.format_all(df).collect()}
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, None: False, 4: False, -1: True}
    assert got[4].loss_chars == 2 and got[4].loss_sha256 == hashlib.sha256(b"yy").hexdigest() and got[1].n_turns == 2
    assert chat.format_all(df.limit(0)).count() == 1
    own = spark.createDataFrame([(-1, 0, "user", "mine"), (-1, 1, "assistant", "too")], "conv_id long, turn long, role string, text string")
    assert sorted(r.loss_chars for r in chat.format_all(own).collect()) == [3, 21]


# 10


def test_shards_are_even_and_gapless(spark, docs, none):
    d = kdshard.shard_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).toPandas()
    sums = d.groupby("shard")["size"].sum()
    assert len(sums) == 40 and sums.max() < 1.05 * sums.mean() and sums.min() > 0.95 * sums.mean()
    assert all((g.sort_values().to_numpy() == np.arange(len(g))).all() for _, g in d.groupby("shard")["slot"])
    rows = kdshard.shard_documents(docs).collect()
    assert len(rows) == docs.count() and kdshard.shard_documents(none).count() == 0
    for r in kdshard.shard_documents(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 40


def test_target_bytes_and_hot_keys(spark):
    df = spark.range(3000).select((F.col("id") % 3 * 0 + 5).alias("d"), F.lit(10).cast("long").alias("size"), F.lit(1).cast("long").alias("tie"), F.crc32(F.col("id").cast("string")).alias("tie2"))
    out = kdshard.shard(df, ["d"], "size", ["tie", "tie2"], target_bytes=3000).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(out) == 10 and max(r.s for r in out) < 3100


def brute_shards(points, leaves):
    """The tree grown by sorting: {point: shard} of rows (tie, dims.., weight)."""
    extent = [max(1, max(p[d] for p in points) - min(p[d] for p in points)) for d in (1, 2)]
    out = {}

    def split(own, k, first):
        if k == 1 or not own:
            out.update({p: first for p in own})
            return
        d = max((1, 2), key=lambda d: ((max(p[d] for p in own) - min(p[d] for p in own)) / extent[d - 1], -d))
        goal, seen, left = sum(p[3] for p in own) * (k // 2) / k, 0, []
        own = sorted(own, key=lambda p: (p[d], p[0]))
        for p in own:
            if seen + p[3] >= goal:
                if goal - seen >= p[3] - (goal - seen):
                    left.append(p)
                break
            seen += p[3]
            left.append(p)
        split(left, k // 2, first)
        split(own[len(left) :], k - k // 2, first + k // 2)

    split(list(points), leaves, 0)
    return out


@pytest.mark.parametrize("leaves", [1, 2, 7, 40])
def test_tree_against_sorting(spark, monkeypatch, leaves):
    monkeypatch.setattr(kdshard, "BINS", 16)
    monkeypatch.setattr(kdshard, "LEVELS", 2)
    rng = np.random.default_rng(10)
    points = [(int(t), int(a), int(b), int(w)) for t, a, b, w in zip(rng.permutation(1 << 20)[:700], rng.integers(-1, 50, 700), rng.integers(0, 1 << 32, 700) // 7 % 9 * 400_000_000, rng.integers(4, 90, 700))]
    df = spark.createDataFrame(points, "kd_tie long, a long, b long, w long")
    got = {(r.kd_tie, r.a, r.b, r.w): r.shard for r in kdshard.grow(df, ["a", "b"], "w", leaves, tolerance=0.0).collect()}
    assert got == brute_shards(points, leaves)


def test_equal_texts_share_a_shard(spark):
    rng = np.random.default_rng(11)
    texts = [f"text {i} " + "x" * int(rng.integers(0, 300)) for i in range(900)]
    texts += [t for t in texts[:60] for _ in range(int(rng.integers(1, 5)))] + ["hot " * 40] * 1500 + ["", None] * 5
    rows = [(int(i), t, str(rng.choice(["en", "de"])), None if i % 9 == 0 else f"s{i % 5}", 1) for i, t in zip(rng.permutation(len(texts)), texts)]
    got = kdshard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int"), leaves=8).collect()
    text, shards, sums = {r[0]: r[1] or "" for r in rows}, {}, Counter()
    for r in got:
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
        sums[r.shard] += r["size"]
    assert len(got) == len(rows) and all(len(s) == 1 for t, s in shards.items() if not t.startswith("hot")) and len(shards["hot " * 40]) >= 4
    mean = sum(sums.values()) / 8
    assert len(sums) == 8 and all(abs(s - mean) < 0.1 * mean for s in sums.values())


# kernel


def test_tokens_and_shingles(docs):
    texts = [r.text for r in docs.collect()]
    names: dict = {}
    for first, end, data, offsets in text_slices(pa.array(texts, pa.string()), 1000):
        tokens = tokenize(data, offsets, SPACE)
        grams_, off = shingles(tokens)
        for d in range(end - first):
            words = WORD.findall(low(texts[first + d]))
            got = tokens.hashes[tokens.offsets[d] : tokens.offsets[d + 1]].tolist()
            assert len(got) == len(words) and all(names.setdefault(w, h) == h for w, h in zip(words, got))
            assert off[d + 1] - off[d] == (max(1, len(words) - 4) if words else 0)
    assert len(set(names.values())) == len(names)
