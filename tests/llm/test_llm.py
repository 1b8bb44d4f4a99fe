import collections
import hashlib
import io
import os
import random
import re
import sys
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from factgraph.llm import (html_blocks, kmeans_tree, mixing, ngram_join, ordinal, packing, quality_rules, sharding,
                           suffix_dedup, warc)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 long, rank string, `row` int, bucket int"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(n))


def texts():
    rng = random.Random(3)
    base = words(rng, 300)
    parts = base.split()
    near = [" ".join(parts[:i] + ["changed"] + parts[i + 1:]) for i in (3, 150, 290)]
    passage = words(rng, 70)
    return [base, base, *near, words(rng, 60) + " " + passage, passage + "\n" + words(rng, 80), "", None, "one", "one two",
            "a" * 900, "ab " * 400, "é" * 150, words(rng, 20_000), "x\0y", " \n\t ", "naïve " + words(rng, 300),
            "<|endoftext|> tail", "one"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ("src0", "src1", "new", None)[i % 4], None if t is None else len(t), 1, "r", 2, 3) for i, t in enumerate(texts())]
    rows += [(None, "no id " + words(random.Random(5), 60), None, None, None, None, None, None, None), rows[0], rows[0]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_frame_keeps_within_a_block():
    for shares in ([8, 6, 4, 4, 2, 2, 6], [5, 1, 1, 1, 1, 1], [1], [97, 3, 1]):
        slots, length = mixing.frame(shares), sum(shares)
        assert sorted(s for own in slots for s in own) == list(range(length))
        for t in range(length + 1):
            for own, share in zip(slots, shares):
                assert abs(sum(s < t for s in own) - share * t / length) < 1


def test_phases_equal_a_sequential_schedule():
    shares, blocks = [5, 2, 1], [40, 3, 11]
    left, expected = list(blocks), []
    while any(left):        # slot by slot: released block with the earliest deadline, shares renewed when one ends
        alive = [i for i, n in enumerate(left) if n]
        total, used, t = sum(shares[i] for i in alive), collections.Counter(), 0
        while all(left[i] for i in alive):
            ready = [(-(-(used[i] + 1) * total // shares[i]), i) for i in alive if used[i] * total // shares[i] <= t]
            i = min(ready)[1]
            used[i] += 1
            left[i] -= 1
            t += 1
            expected.append(i)
    got = {}
    for p in mixing.phases(shares, blocks):
        for k in range(p["end_block"] - p["first_block"]):
            got[p["start_slot"] + k // p["share"] * p["frame"] + p["slots"][k % p["share"]]] = p["stream"]
    assert [got[s] for s in range(len(expected))] == expected


def test_mix(docs, none):
    rows = mixing.positions(docs, weights={"src0": 2, "src1": 1}, other=1, block_rows=2).collect()
    assert sorted(r.position for r in rows) == list(range(docs.count()))
    assert {r.stream for r in rows} == {"src0", "src1", "other"}
    order = [(r.slot, r.position) for r in sorted(rows, key=lambda r: r.position)]
    assert order == sorted(order)
    assert mixing.positions(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("most", [64, 5])
def test_every_source_has_its_share(spark, most):
    # one unlisted source has more rows than all others together
    sizes = {"src0": 400, "src1": 300, None: 120, **{f"new{i}": 120 for i in range(5)}, "hot": 1500}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    table = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    got = mixing.positions(table, weights={"src0": 4, "src1": 3}, other=7, block_rows=4, most_sources=most).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    order = [r.source for r in sorted(got, key=lambda r: r.position)]
    weight = {s: {"src0": 4, "src1": 3}.get(s, 1) / 14 for s in sizes}
    # while no source has ended, every stretch from the start holds each one's part within a block, in a pool, too
    for t in range(0, 1300, 4):
        seen = collections.Counter(order[:t])
        assert all(abs(seen[s] - w * t) < 4 + 1e-9 for s, w in weight.items()), t


def test_many_unlisted_sources_keep_within_a_block(spark):
    """200 sources in a pool: turns among equals and the pool's own slots are off by less than one block together."""
    sizes = {"src0": 900, None: 16, **{f"new{i}": 16 for i in range(198)}, "hot": 3000}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    table = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    got = mixing.positions(table, weights={"src0": 5}, other=9, block_rows=4).collect()
    order = [r.source for r in sorted(got, key=lambda r: r.position)]
    weight = {s: 5 / 14 if s == "src0" else 9 / 14 / 200 for s in sizes}
    seen, done = collections.Counter(), 0
    for t in range(0, 900 * 14 // 5 - 8, 4):        # until the first source ends
        seen.update(order[done:t])
        done = t
        assert all(abs(seen[s] - w * t) < 4 for s, w in weight.items()), t


def plain_measures(text):
    ws, found, now = [], [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if now:
                ws.append(now)
            now = ""
        else:
            now += c
    windows = collections.Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            len(ws) < 50 or 100 * len(covered) > 50 * len(ws))


def test_quality_rules(spark, docs, none):
    odd = docs.unionByName(spark.createDataFrame(
        [(50, "a b c a b c\n\na b c\nx # $ <>\x1c y z\n \na b c", *[None] * 7)], DOCS))
    text_of = {r.doc_id: r.text for r in odd.collect()}
    for r in quality_rules.judge(odd).collect():
        assert tuple(r[1:7]) == plain_measures(text_of[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality_rules.keep(odd).collect()}
    assert {0, 5, 6, 17} <= kept and not kept & {7, 8, 9, 11, 12}
    assert quality_rules.keep(odd).columns == docs.columns and quality_rules.judge(none).count() == 0
    pack = quality_rules.zstandard.ZstdCompressor(level=3)
    noise = "".join(random.Random(1).choices("".join(map(chr, range(33, 127))), k=6000))
    assert not quality_rules.measures(" ".join(noise[i:i + 60] for i in range(0, 6000, 60)).encode(), pack)[6]


def test_quality_bands_keep_real_prose():
    from pydoc_data.topics import topics
    pack = quality_rules.zstandard.ZstdCompressor(level=3)
    prose = [t for t in topics.values() if len(t) >= 4096]
    found = [quality_rules.measures(t.encode(), pack) for t in prose]
    found = [m for m in found if not m[5]]
    assert len(found) >= 20 and sum(m[6] for m in found) >= 0.9 * len(found)     # two are drawn tables
    rng = random.Random(8)
    numbers = "".join(f"Item {i} costs {rng.randrange(1000)}.{rng.randrange(100):02d} today, order {rng.randrange(10 ** 6)} ships.\n"
                      for i in range(4000))
    few = " ".join(rng.choices(words(rng, 10).split(), k=40_000))
    for text in (numbers, few):
        for n in (2000, 4096, 8000, 20_000, 70_000):
            assert not quality_rules.measures(text[:n].encode(), pack)[6]


def pages(spark):
    big = "<p>" + "é" * 700 + "</p>"
    return spark.createDataFrame([(1, "http://a", big, 1), (5, "http://b", big, 1), (3, None, big, 1), (5, "http://b", big, 1), (4, "u", "small", 1),
                                  (6, "u", "small", 1), (7, "u", None, 1), (None, "u", big, 1), (8, "u", "", 1), (9, "u", "x" * 300_000, 1)],
                                 "page_id long, url string, html string, digest int")


def test_warc(spark):
    table = pages(spark)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(table).collect()}
    assert warc.round_trip(table).count() == table.count()
    expected = set()
    for r in table.collect():
        data = (r.html or "").encode()
        revisit = len(data) >= 1000 and r.page_id not in (5, 9)
        expected.add((r.page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == expected
    assert warc.round_trip(table.limit(0)).count() == 0


def test_warc_of_a_long_url_and_a_hot_payload(spark):
    url = "http://a.example/" + "p" * (2 << 20)
    body = "<p>" + "same page " * 200
    rows = [(1, url, "x" * 1500), (None, "u", body), (7, "u", body), (7, "u", body), (9, "u", None)] + [(i, f"u{i}", body) for i in range(20, 60)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows) and [r.url for r in got if r.page_id == 1] == [url]
    same = [r for r in got if r.payload_bytes == len(body)]
    assert [(r.page_id, r.refers_to) for r in same if r.record_type == "response"] == [(59, None)]
    assert {r.refers_to for r in same if r.record_type == "revisit"} == {59}


def test_map_columns(spark):
    rows = spark.createDataFrame([(i, f"t {i % 3} " + "a b c d e f " * 3, "s", {"k": i}) for i in range(9)],
                                 "doc_id long, text string, source string, m map<string,int>")
    assert sorted(r.m["k"] for r in mixing.mix(rows).collect()) == list(range(9))
    assert sorted(r.doc_id for r in ngram_join.keep_one(rows).collect()) == [0, 1, 2]


def test_warc_reader_rejects_damage():
    good = warc.record(1, "u", b"payload" * 100, None, False) + warc.record(2, "u", b"", None, False)
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(good))] == [700, 0]
    plain = zlib.decompress(good, 31)
    for bad in (plain.replace(b"payloadpay", b"payloadpax", 1), plain.replace(b"Content-Length: 7", b"Content-Length: 6", 2), b"junk\r\n\r\n"):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(pack.compress(bad) + pack.flush())))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:len(good) // 3])))


def test_html(spark):
    page = ("<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><header><p>Site of the year</p></header>"
            "<nav><a href=/>Home</a></nav><div class='cookie-notice'>We use the cookies of this site</div>"
            "<article><h1>A  title &amp; more</h1><p>First <b>bold</b> &lt;x&gt;\n text.</p><p>Short.</p>"
            "<form>Mail <input></form><div class=ad>Buy</div><!-- <p>hidden</p> --></article>"
            "<aside>Also of interest</aside><section id=comments><p>I liked the whole of it</p></section><footer>&copy; us</footer>")
    assert html_blocks.main_text(page) == "A title & more\nFirst bold <x> text.\nShort."
    for broken in ("", None, "<", "a < b", "<p>unclosed", "</div></p>text", "<a href='x>y</a>", "<!-- open", "<script>open"):
        assert isinstance(html_blocks.main_text(broken), str)
    plain = ("<div><a href=1>One</a> <a href=2>Two</a></div><p>" + "It was the end of the day and they were on the way to it. " * 4
             + "</p><p>So it was.</p><p>" + "He had been with her for all of the time that was left. " * 4 + "</p><ul><li><a href=3>Next page</a></li></ul>")
    assert html_blocks.main_text(plain).count("\n") == 2 and "One" not in html_blocks.main_text(plain)
    got = html_blocks.extract(pages(spark)).collect()
    assert len(got) == 10 and all(r.n_chars == len(r.text) for r in got)
    assert html_blocks.extract(pages(spark).limit(0)).count() == 0


def test_html_of_other_languages_and_no_prose():
    nav = "<nav><a href=1>Home</a></nav><p><a href=2>One</a> <a href=3>Two</a> <a href=4>Three</a></p>"
    foot = "<footer>Copyright</footer>"
    for title, body in (
            ("Погода", "Вчера вечером над городом прошла сильная гроза, и многие улицы остались без света до самого утра следующего дня. "),
            ("Pogoda", "Wczoraj wieczorem nad miastem przeszła silna burza, przez którą wiele ulic pozostało bez prądu aż do samego rana. "),
            ("Hava", "Dün akşam şehrin üzerinden güçlü bir fırtına geçti ve birçok sokak ertesi sabaha kadar elektriksiz kaldı. "),
            ("天气", "昨天晚上一场强烈的雷暴袭击了这座城市，许多街道一直到第二天早上都没有电，人们只能点着蜡烛等待天亮。"),
            ("天気", "昨夜は激しい雷雨が街を襲い、多くの通りが翌朝まで停電したままで、人々はろうそくを灯して夜明けを待っていました。")):
        page = f"{nav}<div><h1>{title}</h1><p>{body * 2}</p><p>{body}</p></div>{foot}"
        assert html_blocks.main_text(page) == f"{title}\n{(body * 2).strip()}\n{body.strip()}"
    code = "while (next &lt; rows) { total += price[next] * count[next]; next++; } return total / n; // mean price\n" * 3
    prose = "It was the end of the day and they were on the way to it, as they had been for most of the week before. " * 2
    assert html_blocks.main_text(f"{nav}<pre>{code}</pre>{foot}").count("total / n") == 3
    assert html_blocks.main_text(f"{nav}<p>{prose}</p><pre>{code}</pre><p>{prose}</p>{foot}").count("total / n") == 3
    assert "total" not in html_blocks.main_text(f"{nav}<p>{prose * 3}</p><p>{prose}</p><pre>{code}</pre>{foot}")
    items = "".join(f"<li>{n} g flour, sifted twice</li>" for n in range(9))
    cells = "".join(f"<tr><td>Lot {n}</td><td>{n * 7} kg</td></tr>" for n in range(9))
    assert html_blocks.main_text(f"{nav}<ul>{items}</ul>{foot}").count("flour") == 9
    assert html_blocks.main_text(f"{nav}<table>{cells}</table>{foot}").count("kg") == 9


def test_html_of_deep_pages_and_formulas():
    prose = "This is the text of the page and it was written for you, so that it has the words that are in it. " * 3
    for page in ("<div>" * 100_000 + f"<p>{prose}</p>" + "</section></p>" * 100_000,
                 f"<article><p>{prose}</p>" + "<div class=sidebar>x" * 20_000 + "</nav>" * 20_000,
                 f"<div class=widget><p>{prose}</p>" * 3_000):
        tracemalloc.start()
        began = time.process_time()
        text = html_blocks.main_text(page)
        used, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert prose.strip() in text and peak < 50 << 20 and used < 20
    formula = "<math><mi>a</mi><mo>+</mo><msup><mi>b</mi><mn>2</mn></msup><annotation>\\tex</annotation></math>"
    assert html_blocks.main_text(f"<article><p>{prose} Here {formula} is.</p><noscript><p>{prose}</p></noscript></article>") == \
        f"{prose.strip()} Here a+b2 is.\n{prose.strip()}"


def test_html_hints_are_whole_tokens_and_give_way():
    prose = ("It was the end of the day and they were on the way to it, as they had been for most of the week before. " * 3).strip()
    more = ("He had been with her for all of the time that was left, and it was not as long as they had been told. " * 2).strip()
    for name in ("site-content no-sidebar", "layout has-sidebar", "post hentry comments-open", "elementor-widget-container",
                 "single-post social-issues", "sidebar", "main-menu widget"):
        for tag in ("div", "article"):
            page = f"<nav>Home</nav><{tag} class='{name}'><h1>Title</h1><p>{prose}</p><p>{more}</p></{tag}><footer>End</footer>"
            assert html_blocks.main_text(page) == f"Title\n{prose}\n{more}", (tag, name)
        page = f"<nav>Home</nav><div class='{name}'><article><h1>Title</h1><p>{prose}</p></article></div><footer>End</footer>"
        assert html_blocks.main_text(page) == f"Title\n{prose}", name
    assert html_blocks.main_text("<div class=widget><article><h1>Title</h1><p>Short.</p></article></div>") == "Title\nShort."
    for header in ("<header class=entry-header>", "<header class='post-header header'>"):
        page = f"<article>{header}<h1>Title</h1></header><p>{prose}</p></article>"
        assert html_blocks.main_text(page) == f"Title\n{prose}"
    for name in ("sidebar", "site-footer", "cookie-notice", "related-posts", "comments", "comment-list", "main-nav", "ad"):
        page = f"<article><h1>Title</h1><p>{prose}</p></article><div class={name}><p>{more}</p><article>{more}</article></div>"
        assert html_blocks.main_text(page) == f"Title\n{prose}", name
    assert html_blocks.main_text(f"<div><p>{more}</p></div><div class=comments><p>{prose}</p><p>{prose}</p></div>") == more


def brute_removals(bodies, length):
    seen = collections.Counter(t[p:p + length] for t in bodies for p in range(len(t) - length + 1))
    out = []
    for t in bodies:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [50_000, 2])
def test_suffix_dedup(docs, none, hot):
    rows = docs.collect()
    expected = collections.Counter(
        (r.doc_id, *m) for r, m in zip(rows, brute_removals([(r.text or "").encode() for r in rows], 200)))
    assert collections.Counter(map(tuple, suffix_dedup.removals(docs, hot_gram=hot).collect())) == expected
    if hot == 2:
        assert suffix_dedup.removals(none).count() == 0
        left = suffix_dedup.remove(docs)
        assert left.columns == docs.columns
        by_id = {r.doc_id: r for r in left.collect()}
        assert 0 not in by_id and 11 not in by_id and by_id[8].text is None and by_id[17].n_chars == len(by_id[17].text)


def test_heavy_start_fills_several_buckets(spark):
    rng = random.Random(12)
    some = ["".join(rng.choices("ab", (12, 1), k=600)) for _ in range(30)]
    rows = [(i, some[i] + some[rng.randrange(30)][100:400]) for i in range(30)]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    try:
        got = suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    expected = [(i, *m) for (i, _), m in zip(rows, brute_removals([t.encode() for _, t in rows], 200))]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_buckets_of_a_shared_start():
    grams = [b"startstart%022d" % i for i in range(200)]
    texts = [g + b"x" * 300 for g in grams] * 2
    place = {"at": 0, "back": 0, "ahead": 0, "hot": False}
    kind = pa.list_(pa.struct([("at", pa.int32()), ("back", pa.int32()), ("ahead", pa.int32()), ("lead", pa.int64()), ("hot", pa.bool_())]))
    run = suffix_dedup._cutter(200, np.array([3, 5, 5, 5, 9]))

    def buckets(lead):
        batch = pa.RecordBatch.from_arrays(
            [pa.array([1] * 400), pa.array([2] * 400), pa.array(texts), pa.array([[{**place, "lead": lead}]] * 400, kind)],
            names=["k1", "k2", "body", "places"])
        return [r["part"] for b in run(iter([batch])) for r in b.to_pylist()]

    assert [set(buckets(x)) for x in (2, 3, 4, 5, 6, 9)] == [{0}, {1}, {1}, {2, 3, 4}, {4}, {5}]
    assert buckets(5)[:200] == buckets(5)[200:]


def test_multikey_order():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    assert sorted(map(tuple, rows)) == [tuple(r) for r in rows[suffix_dedup.multikey_order(rows)]]


def test_sharding(docs, none):
    many = docs.crossJoin(docs.sparkSession.range(40).withColumnRenamed("id", "extra"))
    rows = sharding.shard(many).collect()
    text_of = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == many.count() and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for r in rows:
        assert (r.size, r.text_crc32) == (len(text_of[r.doc_id]) + 1, zlib.crc32(text_of[r.doc_id]))
    mix = collections.Counter((r.shard, r.source) for r in rows)
    for source, total in collections.Counter(r.source for r in rows).items():
        assert all(abs(mix[s, source] - total / 16) <= 2 for s in sizes)
    assert sharding.shard(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(packing.tokenizer_paths()[0])
    ids = {r.doc_id: exact.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    rows = packing.pack(docs.repartition(8), open_windows=2, fan_in=2).collect()
    covered, sequences = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert (len(piece), zlib.crc32(piece.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = collections.Counter(r.doc_id for r in docs.collect())
    assert covered == {k: len(v) * copies[k] for k, v in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= sum(covered.values()) / 2048 * 1.2 + 1
    assert packing.pack(none).count() == 0


def test_merge_rounds_hand_on_open_windows_only(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(i, words(rng, rng.randint(1, 400))) for i in range(400)]
    rows = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    kept = []
    plain_keep = packing.Scratch.keep
    monkeypatch.setattr(packing.Scratch, "keep", lambda self, df, name="t": kept.append((name, plain_keep(self, df, name))) or kept[-1][1])
    found = packing.pack(rows, open_windows=3, fan_in=4).collect()
    merged = [df for name, df in kept if name == "merged"]
    assert len(merged) == 3         # 40 tasks, 10, 3, 1
    for df in merged:
        assert max(r["count"] for r in df.groupBy("to_task").count().collect()) <= 4 * 3
    assert sorted((r.doc_id, r.start) for r in found) == sorted((r.doc_id, 0) for r in found) and len(found) == 400
    held = collections.defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) < 1.2 * sum(r.length for r in found) / 2048 + 3       # three open windows leave some room


def test_samples_are_few_rows_of_every_size(spark):
    from pyspark.sql import functions as F
    from factgraph.llm.ranking import around_least
    rows = spark.range(200_000)
    u = F.xxhash64("id")
    some = around_least(rows, u, 1000, 200_000)
    assert 1000 <= some.count() < 3000
    want = [r.id for r in rows.orderBy(u).limit(1000).collect()]
    assert [r.id for r in some.orderBy(u).limit(1000).collect()] == want
    # far fewer rows than stated, and one key in all of them
    assert around_least(rows.limit(50), u, 1000, 10 ** 9).count() == 50
    assert around_least(rows.select(F.lit(7).alias("id")), u, 1000, 200_000).count() == 200_000


def test_token_ids_equal_the_tokenizer():
    ids, rng = packing.Ids(packing.tokenizer_paths()), random.Random(4)
    pieces = ["a", "b", " ", "  ", "\n", "\t", "é", "12", "'s", "!", "<|endoftext|>", "\x1c", " ", "中", "\r\n", "👍", " \n", "\x85"]
    for _ in range(2000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 25)))
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == ids.exact.encode(text, add_special_tokens=False).ids


def brute_links(rows):
    sets = []
    for r in rows:
        w = (r.text or "").encode().split()
        n = min(5, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else None)
    link = [[i != j and (rows[i].text or "") == (rows[j].text or "") or
             i != j and sets[i] is not None and sets[j] is not None and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
             for j in range(len(rows))] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in range(len(rows)) if link[i][j])]) for i in range(len(rows))]
    name = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            name[root[i]] = min(name.get(root[i], r.doc_id), r.doc_id)
    return collections.Counter((r.doc_id, name.get(root[i]), sum(link[i])) for i, r in enumerate(rows))


@pytest.mark.parametrize("large,block", [(48, 384), (1, 2)])
def test_ngram_join(docs, none, large, block):
    got = ngram_join.links(docs, large, block).select("doc_id", "class_id", "n_links").collect()
    assert collections.Counter(map(tuple, got)) == brute_links(docs.collect())
    if large == 1:
        kept = ngram_join.keep_one(docs, large, block)
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.collect()]
        assert len(ids) == len({(c, n) if c is not None else d for d, c, n in brute_links(docs.collect()) for n in [0]})
        assert ids.count(0) == 1 and not {1, 2, 3, 4, 19} & set(ids)
        assert ngram_join.links(none).count() == 0


def test_posterior_threshold():
    from math import comb
    for n in (17, 85, 170):
        m = ngram_join.least_matches(n)
        tail = lambda k: sum(comb(n + 1, i) * 0.8 ** i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= ngram_join.TOLERANCE > (tail(m - 1) if m else 0)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    vectors = [(i, (centres[i % 12] + rng.normal(size=8) * 0.4).astype(np.float32).tolist(), 1) for i in range(1500)]
    vectors += [(1500 + i, [1.0, *[0.0] * 7], 1) for i in range(400)]        # one very common vector
    vectors += [(2000, None, 1), (2020, [0.0] * 8, 1), (2040, [float("nan")] * 8, 1), (2060, [1.0], 1), (None, [1.0] * 8, 1), (2080, [None] * 8, 1)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, leaf int")
    got = collections.defaultdict(list)
    for r in kmeans_tree.neighbours(table, leaf_rows=32, block_rows=100, block_queries=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids = np.arange(1900)
    x = np.array([v for _, v, _ in vectors[:1900]], np.float64)
    hits = 0
    assert set(got) == set(range(0, 1900, 20))
    for q, found in got.items():
        score = np.where(ids == q, -np.inf, (x * x[q]).sum(1))
        true = [int(i) for i in np.lexsort((ids, -score))[:20]]
        hits += len(set(true) & {v for v, _ in found})
        assert len(found) == 20 and all(s == score[v] for v, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert hits / (20 * len(got)) >= 0.9
    assert kmeans_tree.neighbours(table.limit(0)).count() == 0


def test_neighbours_beside_a_dominant_cluster(spark):
    # nearly all queries have their neighbours in one leaf; two outliers, one with copies of its id, lie in small ones
    vectors = [(i, [10.0, 0.0, 0.0]) for i in range(1980)]
    vectors += [(1980, [0.0, 50.0, 0.0]), (1981, [0.0, 50.0, 1.0]), *[(2000, [0.0, 0.0, -50.0])] * 30]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = collections.Counter(r.query_id for r in kmeans_tree.neighbours(table, leaf_rows=16, block_rows=200).collect())
    assert got == dict.fromkeys({i for i, _ in vectors if i % 20 == 0}, 20)


def test_ordinal_held_out(spark, docs, none):
    rng = random.Random(6)
    vocabulary = [words(rng, 1) for _ in range(400)]
    rows, rated = [], []
    for i in range(900):
        quality, toxic = int(rng.random() < 0.7), int(rng.random() < 0.3)
        body = rng.choices(vocabulary, k=80)
        if not quality:
            body = [w + "###" for w in body]
        if toxic:
            body[::9] = rng.choices(["vile", "scum", "fool"], k=len(body[::9]))
        rows.append((i, " ".join(body)))
        rated.append((i, quality, toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*rated[:600], (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ordinal.grade(table, labels).collect()}
    right = sum(got[i].grade == (0 if t else 1 if not q else 2) for i, q, t in rated[600:])
    assert right >= 0.9 * 300
    assert all(0 <= r.top_probability <= r.expected_grade <= 2 for r in got.values())
    assert ordinal.grade(docs, labels).count() == docs.count()
    assert ordinal.grade(none, labels).count() == 0
    assert ordinal.grade(docs, labels.limit(0)).count() == docs.count()


def plain_keep_one(rows):
    """Of each class of linked rows, the one with the least id (null last); equal rows once."""
    links = plain_links([r.text for r in rows])
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[max(top(i), top(j))] = min(top(i), top(j))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i])
    return [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]


def plain_links(texts):
    shingles = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        shingles.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return [(i, j) for i in range(len(texts)) for j in range(i)
            if (texts[i] or "") == (texts[j] or "") or shingles[i] and 10 * len(shingles[i] & shingles[j]) >= 8 * len(shingles[i] | shingles[j])]


def plain_without_repeats(rows, length=200):
    """Texts without the bytes of strings that start twice; cut characters go, and texts of which nothing is left."""
    bodies = [(r.text or "").encode() for r in rows]
    count = collections.Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        if not any(gone):
            out.append((r.doc_id, r.text))
            continue
        pieces = "".join(bytes(c for c, g in run if not g).decode("utf-8", "ignore") for run in [list(zip(b, gone))])
        if pieces.strip():
            out.append((r.doc_id, pieces))
    return out


def test_pipeline(spark, docs, tmp_path, monkeypatch):
    import corpus_pipeline
    from factgraph.functions import storage
    rng = random.Random(31)
    passage = words(rng, 60)
    more = [(100 + i, words(rng, 70 + 5 * i) + (" " + passage if i % 3 == 0 else "") + " end of it", "en", f"src{i % 8}", 1, 1, "r", 2, 3) for i in range(12)]
    docs = docs.unionByName(spark.createDataFrame(more, DOCS))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # every stage against a plain version of it, on what the stage before kept
    at, kept = docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = at.collect()
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        at = spark.read.parquet(f"{tmp_path}/stage{i}")
        assert at.columns == docs.columns, name
        kept.append((before, at.collect()))
    key = lambda rows: sorted((str(r[0]), r[1]) for r in rows)
    (given, good), (_, one), (_, cut), (_, mixed) = kept
    pack = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    fine = [r for r in given if not plain_measures(r.text)[-1] and quality_rules.measures((r.text or "").encode(), pack)[6]]
    assert key(good) == key(fine) and len(good) > 15
    assert key(one) == key(plain_keep_one(good)) and len(one) < len(good)
    assert key(cut) == key(plain_without_repeats(one)) and any(r.text not in {x.text for x in one} for r in cut)
    assert sorted(map(str, mixed)) == sorted(map(str, cut))
    # a shared folder of its own, to see what is left in it
    for module in (storage, corpus_pipeline):
        monkeypatch.setattr(module, "shared_folder", lambda spark: str(tmp_path / "shared"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(packing.tokenizer_paths()[0])
    want = {str(r.doc_id): np.array(exact.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in mixed}
    assert {str(r.doc_id) for r in packed} == set(want)
    for r in packed:
        ids = want[str(r.doc_id)]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    # nothing but the last stage is left in the shared folder
    left = [os.path.join(d, f) for d, _, files in os.walk(tmp_path / "shared") for f in files]
    assert left and all("/pipeline-" in f and "/4/" in f for f in left), left


def test_packing_keeps_the_mixed_order(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(9)
    # short texts come first and long ones last, so that the last files are the largest
    rows = [(i, words(rng, 30 if i < 150 else 900), "en", "src0" if i % 3 else "new", None, None, None, None, None) for i in range(240)]
    stages = dict(corpus_pipeline.STAGES)
    mixed = [r.doc_id for r in stages["mixing"](spark, spark.createDataFrame(rows, DOCS), "").collect()]
    text_of = {r[0]: r[1] for r in rows}
    table = spark.createDataFrame([(d, text_of[d]) for d in sorted(mixed)], "doc_id long, text string")
    table.orderBy("doc_id").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/t")
    stages["mixing"](spark, spark.createDataFrame(rows, DOCS), "").write.parquet(f"{tmp_path}/mixed")
    settings = {"spark.sql.files.maxPartitionBytes": "60k", "spark.sql.files.openCostInBytes": "1", "spark.sql.shuffle.partitions": "5"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for path, order in ((f"{tmp_path}/t", sorted(mixed)), (f"{tmp_path}/mixed", mixed)):
            stored = spark.read.parquet(path)
            read = packing.in_written_order(stored)
            assert [(r.doc_id, r.text) for r in read.collect()] == [(d, text_of[d]) for d in order]
            pieces = stages["packing"](spark, stored, "").collect()
            assert collections.Counter(r.doc_id for r in pieces if r.start == 0) == collections.Counter(order)
            from tokenizers import Tokenizer
            exact = Tokenizer.from_file(packing.tokenizer_paths()[0])
            for r in pieces:
                ids = np.array(exact.encode(text_of[r.doc_id], add_special_tokens=False).ids + [1], "<u4")[r.start:r.start + r.length]
                assert zlib.crc32(ids.tobytes()) == r.ids_crc32
            # a sequence's first row in the mixed order never comes before that of the sequence before it
            at, firsts = {d: i for i, d in enumerate(order)}, {}
            for r in pieces:
                firsts[r.sequence_id] = min(firsts.get(r.sequence_id, len(order)), at[r.doc_id])
            ordered = [firsts[s] for s in sorted(firsts)]
            assert ordered == sorted(ordered)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_remembered_words_of_the_grades_stay_small():
    """Words a worker remembers take little memory, and what is forgotten is worked out again alike."""
    from factgraph.llm import ordinal
    first = ordinal.word_places("Word0x")
    for i in range(3 * ordinal.CACHED_WORDS):
        ordinal.word_places(f"Word{i}x")
    assert ordinal.word_places.cache_info().currsize <= 1 << 15
    assert ordinal.word_places("Word0x") == first
