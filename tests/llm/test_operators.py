"""The ten operators against brute-force versions, on small tables with nulls, empty, long and repeated texts."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlane.llm import common, decontaminate, encoding, fingerprint, graph, language, packing, quality, simhash, token_counts, token_files, transducer, url_rules, wrappers

SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def ready(spark):
    return common.prepare(spark)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.default_tokenizer())


def odd_texts() -> list:
    rng = random.Random(3)
    pool = [*"  \n\t'strevlmd abcABC019.,!?-é漢字 ٣²\x0b\x1c\x85😀\r\xa0", "ing", "the", "'ll", " '", "  ", SPECIAL, "  " + SPECIAL + " x"]
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    words = ["".join(rng.choice("abcdeß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(20_000))
    return [None, "", " ", "\n\n", "a", "z" * 3000, long, long, *made]


def documents(spark, texts, **more):
    """A table with ids from 0, and extra columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1.5, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, score double, key string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


# 1


def test_token_counts_equal_the_library(ready, library):
    texts = odd_texts()
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    for chunk in (token_counts.CHUNK, 50):  # whole texts, and texts of very many chunks
        got = token_counts.count_tokens(documents(ready, texts), chunk=chunk)
        assert by_id(got, "n_bytes", "n_tokens") == want
    assert token_counts.count_tokens(empty(ready)).count() == 0


def test_composition_is_associative():
    machine = transducer.Transducer(transducer.load(common.default_tokenizer()))
    maps = [machine.chunk_map(c) for c in ("ab c", "d", "  e's f", "gh", " i\n")]
    left = machine.compose(machine.compose(maps[0], maps[1]), machine.compose(maps[2], maps[3]))
    right = machine.compose(maps[0], machine.compose(machine.compose(maps[1], maps[2]), maps[3]))
    assert left == right
    assert machine.scan(maps) == machine.totals(["ab cd  e's fgh i\n"])[0]


def test_forgotten_transitions_change_nothing():
    machine = transducer.Transducer(transducer.load(common.default_tokenizer()))
    text = ["some words, and MORE words: 12 of them's"] * 3
    want = machine.totals(text)
    machine.LIMIT = 1
    assert machine.totals(text) == want == machine.totals(text)


# 2


def plain_fingerprint(text: str) -> int:
    words = (text or "").encode().lower().split()
    made = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values: list[int], radius: int) -> list[int]:
    """Least position reachable over differences of at most ``radius`` bits."""
    least = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            m = min(least[j] for j, b in enumerate(values) if (a ^ b).bit_count() <= radius)
            changed, least[i] = changed or m < least[i], m
    return least


def near_texts() -> list:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts: list = [None, "", "  ", "one", "one two"]
    for _ in range(6):
        base = [rng.choice(words) for _ in range(220)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts + texts[-2:]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])  # 2: buckets are split again and again
def test_near_duplicates_equal_brute_force(ready, bucket):
    texts = near_texts()
    prints = [plain_fingerprint(t) for t in texts]
    want = {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, plain_components(prints, 3)))}
    got = simhash.near_duplicates(documents(ready, texts), bucket=bucket)
    assert by_id(got, "fingerprint", "component_id") == want


def test_near_duplicates_of_nothing(ready):
    assert simhash.near_duplicates(empty(ready)).count() == 0
    assert simhash.one_of_each(empty(ready)).count() == 0


def test_every_pair_within_the_radius_meets():
    rng = random.Random(1)
    masks = simhash.covering_masks(3)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not flips & m for m in masks)


def test_components_of_a_chain_and_a_star(ready):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in graph.components(ready.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_one_of_each_keeps_unrelated_and_one_copy(ready):
    rng = random.Random(9)
    texts = [" ".join(rng.choice([f"v{i}" for i in range(900)]) for _ in range(150)) for _ in range(20)]
    copies = [texts[0], texts[0].upper(), texts[1] + " tail"]
    rows = [(i, t) for i, t in enumerate(texts + copies)] + [(5, texts[5]), (None, None)]
    kept = [r["doc_id"] for r in simhash.one_of_each(ready.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([*range(20), None], key=str)


def similar_texts() -> list:
    """Short and long texts with appended, inserted, cut and changed copies, of similarities around the least one."""
    rng = random.Random(11)
    texts = []
    for n in (20, 30, 60, 150, 400):
        for _ in range(6):
            base, other = ([f"u{rng.randrange(5000)}" for _ in range(n)] for _ in range(2))
            part, at = n // 10, rng.randrange(n)
            texts += [base, base + other[:part], base + other[:2 * part], base[:at] + other[:part] + base[at:], base[part:], base[:-2 * part], base[:at] + other[:1] + base[at + 1:],
                      base[:at] + other[:3 * part] + base[at:]]
    return [" ".join(t) for t in texts]


def plain_groups(texts: list) -> dict:
    sets = [{" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    least = list(range(len(texts)))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    return {i: m for i, m in enumerate(least)}


@pytest.mark.parametrize("bucket", [8 * simhash.BUCKET, 3])  # 3: buckets are dealt out in parts and blocks
def test_near_copies_equal_brute_force(ready, bucket):
    texts = similar_texts()
    got = by_id(simhash.similar_groups(documents(ready, texts), bucket=bucket), "group")
    first: dict = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    assert {i: first[g] for i, g in got.items()} == plain_groups(texts)


def test_texts_that_operator_2_links_are_near_copies_without_a_common_band(ready):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(words[:150] + ["other"] + words[151:])]
    docs = documents(ready, texts)
    linked, group = by_id(simhash.near_duplicates(docs), "component_id"), by_id(simhash.similar_groups(docs, bands=1, per_band=80), "group")
    pairs = [(i, i + 1) for i in range(0, 50, 2) if linked[i] == linked[i + 1]]
    assert len(pairs) >= 5 and all(group[a] == group[b] for a, b in pairs)


@pytest.mark.parametrize("bucket", [8 * simhash.BUCKET, 3])
def test_a_hot_template_is_one_group_whatever_the_bucket(ready, bucket):
    words = [f"t{i}" for i in range(80)]
    texts = [" ".join(words[:40] + [f"n{i}"] + words[40:]) for i in range(60)]
    assert simhash.one_of_each(documents(ready, texts), bucket=bucket).count() == 1


def test_unlike_texts_are_not_dropped(ready):
    rng = random.Random(13)
    texts = []
    for _ in range(40):  # similarities of 0.6 to 0.75
        base = [f"u{rng.randrange(5000)}" for _ in range(100)]
        texts += [" ".join(base), " ".join(base + [f"x{rng.randrange(5000)}" for _ in range(rng.randint(34, 60))])]
    assert simhash.one_of_each(documents(ready, texts)).count() == 80


def test_texts_of_the_same_words_share_no_bucket(ready):
    rng = random.Random(14)
    words = [f"t{i}" for i in range(60)]
    texts = [" ".join(rng.sample(words, 60)) for _ in range(50)]
    assert simhash.one_of_each(documents(ready, texts), bucket=4).count() == 50


# 3


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><{tag}><h1>{head}</h1><p>{one}<p>{two}&eacute;<br>three &amp; four
  five</p><div class="ad-slot">Buy</div></{tag}><div id="comments"><p>nice</p></div><form>mail <input></form><footer>(c) x</footer></body>"""


def test_main_text(ready):
    rows = [(i, f"http://h{i % 2}.org/p{i}", PAGE.format(tag=("article", "div")[i % 2], head=f"Head {i}", one=f"text number {i} runs on", two=f"caf{i}")) for i in range(8)]
    want = {i: f"Head {i}\ntext number {i} runs on\ncaf{i}é\nthree & four five" for i in range(8)}
    more = [(8, None, None), (9, "no host", ""), (10, "http://h0.org/", "plain  text"), (10, "http://h0.org/", "plain  text"), (None, "http://h9.org", "<p>x</p><"),
            (11, "http://h9.org", "<div>" * 3000 + "deep")]
    df = ready.createDataFrame(rows + more, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("text", F.lit(1))
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in wrappers.extract_text(df).collect()), key=str)
    assert got == sorted([(i, t, len(t)) for i, t in [*want.items(), (8, ""), (9, ""), (10, "plain text"), (10, "plain text"), (None, "x\n<"), (11, "deep")]], key=str)


def test_title_and_lead_outside_the_body_are_kept(ready):
    page = "<body><nav>menu</nav><p>Same on all pages</p><div><h1>Title {i}</h1><p>Lead {i}</p><div class=body><p>{long}</p></div><p>End {i}</p></div></body>"
    long = [" ".join(f"word{i}x{j}" for j in range(200)) for i in range(6)]
    df = ready.createDataFrame([(i, f"http://h.org/{i}", page.format(i=i, long=t)) for i, t in enumerate(long)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_text(df).collect()}
    assert got == {i: f"Title {i}\nLead {i}\n{t}\nEnd {i}" for i, t in enumerate(long)}


def test_wrappers_find_optional_and_repeated_groups():
    a = wrappers.shape(wrappers.parse("<div><p>same</p><ul><li>1<li>2</ul></div>"))
    b = wrappers.shape(wrappers.parse("<div><p>same</p><h2>new</h2><ul><li>3</ul></div>"))
    (div, _, _), = wrappers.joined(a, b)[5]
    assert [(c[0][0], c[1], c[2]) for c in div[5]] == [("p", False, False), ("h2", True, False), ("ul", False, False)]
    assert div[5][0][0][4] == "same" and div[5][2][0][5][0][2] is True and div[5][2][0][5][0][0][4] is None


# 4


def test_quality_on_held_out_rows(ready):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["river", "stone", "walks", "under", "light", "Seven", "paper"]) + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(200)]
    bad = ["### $$$ " * rng.randint(20, 60) for _ in range(200)]
    texts = [t for pair in zip(good, bad) for t in pair] + [None, ""]
    labels = ready.createDataFrame([(i, 1 - i % 2) for i in range(400)] + [(3, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    got = quality.classify(documents(ready, texts), labels).withColumn("held", common.crc_bucket("doc_id", 3) == 1).collect()
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] < 400]
    assert len(held) > 60 and np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.97


def test_quality_without_labels(ready):
    none = ready.createDataFrame([], "doc_id long, quality int")
    assert by_id(quality.classify(documents(ready, ["a", None]), none), "score", "predicted") == {0: (0.5, 1), 1: (0.5, 1)}
    assert quality.classify(empty(ready), none).count() == 0


def test_isotonic_is_the_closest_nondecreasing_sequence():
    assert quality.isotonic([1, 1, 2, 1], [0.0, 1.0, 0.5, 2.0]) == pytest.approx([0, 2 / 3, 2 / 3, 2])


# 5 and 10


def test_packing_round_trip(ready, library):
    texts = odd_texts()
    pieces = packing.pack(documents(ready, texts), length=64).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    got: dict = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        assert p["start"] == len(got.setdefault(p["doc_id"], [])) and p["length"] == len(p["ids"]) and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        got[p["doc_id"]].extend(p["ids"])
    assert got == ids
    fill: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill.get(p["sequence_id"], 0)
        fill[p["sequence_id"]] = p["offset"] + p["length"]
    assert sorted(fill) == list(range(len(fill))) and all(fill[s] == 64 for s in range(len(fill) - 1))
    assert packing.pack(empty(ready)).count() == 0


def test_hilbert_neighbours_are_one_step_apart():
    n, bits = 3, 3
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
    keys = packing.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(1 << n * bits))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("delta", [False, True])
def test_token_files_round_trip(ready, library, delta, tmp_path):
    texts = odd_texts()
    files = token_files.write_tokens(documents(ready, texts), path=str(tmp_path / "t"), delta=delta, page_rows=10)
    want, start = {}, 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert by_id(token_files.token_index(files), "start", "n_tokens", "ids_crc32") == want
    import pyarrow.parquet as pq

    columns = [pq.ParquetFile(f).metadata.row_group(0).column(2) for f in sorted((tmp_path / "t").glob("*.parquet")) if pq.ParquetFile(f).metadata.num_row_groups]
    assert columns and all(c.has_offset_index for c in columns)
    assert any("DELTA_BINARY_PACKED" in c.encodings if delta else c.has_dictionary_page for c in columns)
    assert token_files.token_index(token_files.write_tokens(empty(ready))).count() == 0


def test_starts_are_places_in_the_files(ready, tmp_path):
    """Also of rows that share an id, and where a file is read in several parts."""
    rows = [(i, f"text {i} {j} " * (1 + (3 * (i or 0) + j) % 4)) for i, n in ((None, 2), (0, 1), (1, 5), (2, 3), (3, 200)) for j in range(n)]
    df = ready.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files = token_files.write_tokens(df, path=str(tmp_path / "t"), row_group=1)
    ready.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        got = sorted(tuple(r) for r in token_files.token_index(files).select("start", "n_tokens", "ids_crc32").collect())
    finally:
        ready.conf.unset("spark.sql.files.maxPartitionBytes")
    import pyarrow.parquet as pq

    want, start = [], 0
    for f in sorted((tmp_path / "t").glob("*.parquet")):
        for ids in pq.read_table(f).column("ids").to_pylist():
            want.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert got == want and len(want) == len(rows)


def test_one_id_is_read_without_the_other_pages(ready, tmp_path):
    import pyarrow.parquet as pq

    rows = [(i, f"text {i} " * 200) for i in range(2000)]
    files = token_files.write_tokens(ready.createDataFrame(rows, "doc_id long, text string").coalesce(1), path=str(tmp_path / "t"), row_group=20_000, page_rows=50)
    assert files.filter("doc_id = 1234").select("ids").count() == 1
    groups = [(f.metadata.row_group(g).column(0).statistics, f.metadata.row_group(g).total_byte_size)
              for f in map(pq.ParquetFile, sorted((tmp_path / "t").glob("*.parquet"))) for g in range(f.metadata.num_row_groups)]
    hit = sum(size for s, size in groups if s.min <= 1234 <= s.max)
    assert hit * 4 < sum(size for _, size in groups)  # the id's row group against all


def test_encoder_looks_each_distinct_unit_up_once_a_call(library):
    class Known(dict):
        looked = 0

        def get(self, *a):
            self.looked += 1
            return super().get(*a)

    encoder = encoding.Encoder(common.default_tokenizer())
    encoder.known = Known()
    text = "one two" + " one two" * 500
    ids, edges = encoder.encode([text, "", text])
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and edges.tolist() == [0, len(want), len(want), 2 * len(want)]
    assert encoder.known.looked == len(encoder.known) == 3


def test_texts_are_cut_between_visible_and_blank():
    texts = ["", " a  b", "c\n", " ", "\t é\r\nd", ""]
    units, edges = encoding.cut(texts)
    assert units.to_pylist() == [" a", "  b", "c", "\n", " ", "\t é", "\r\nd"] and edges.tolist() == [0, 0, 2, 4, 5, 7, 7]
    units, edges = encoding.cut(["", ""])
    assert units.to_pylist() == [] and edges.tolist() == [0, 0, 0]


def test_encoder_equals_the_library(library):
    texts = [t or "" for t in odd_texts()]
    encoder = encoding.Encoder(common.default_tokenizer())
    assert encoder.sizes is not None  # new units are encoded together
    for encoder.KEPT in (100, encoding.Encoder.KEPT):  # forgets all the time, or not
        ids, edges = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_joined_units_are_told_apart(library):
    encoder = encoding.Encoder(common.default_tokenizer())
    units = [b + w for b in (" ", "\n", "  ", "\t\r\n ") for w in ("a", "don't", "é日本", "<|endoftext|>", "x<|endoftext|>y", "😀!", "12,5", "wordlike" * 5)]
    for make in (encoder.joined, encoder.each):
        ids, lengths = make(units)
        assert [i.tolist() for i in np.split(ids, np.cumsum(lengths)[:-1])] == [library.encode(u, add_special_tokens=False).ids for u in units]
    encoder.sizes = encoder.sizes + 1  # lengths that do not fit: each unit by itself
    assert encoder.joined(units)[0].tolist() == ids.tolist()


def same_ids(encoder, library, texts):
    ids, edges = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_one_unit_whatever_mark_follows(library):
    encoder = encoding.Encoder(common.default_tokenizer())
    assert same_ids(encoder, library, ["an end, an end. an end!! an end", "an end"])
    assert set(encoder.known) == {"an", " end", " an", ",", ".", "!!"}


def test_units_met_again_are_not_encoded_again(library):
    encoder = encoding.Encoder(common.default_tokenizer())
    encoder.KEPT, encoded, by_library = 60, [], encoder.by_library
    encoder.by_library = lambda strings: encoded.extend(strings) or by_library(strings)
    for new in ([""], [" one two three"], [" four five six seven eight nine ten eleven"], [" twelve thirteen"], [" one"]):
        assert same_ids(encoder, library, ["first common", *new, "first common"])
    assert encoded.count("first") == 1 and "".join(encoded).count(" common") == 1
    assert "".join(encoded).count(" one") == 2  # met once before room was made
    encoder.again[:] = True
    encoder.KEPT = 1  # units met again that leave no room are forgotten too
    assert same_ids(encoder, library, ["first common"]) and encoder.held == len("first common")


def test_cut_before_marks_equals_the_library(library, tmp_path):
    rng = np.random.default_rng(5)
    parts = ["a", "Zs", "1", "t", "ve", "é", "日", "\u0301", "“", "😀", "²", "ª", "\u200b", " ", "  ", "\n", "\t", *"!\"'()*+,-./:;<=>?@[]^_`{|}~#$%&\\", "<|endoftext|>", "'s", "'re", "don't", "x.y"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(4000)]
    assert same_ids(encoding.Encoder(common.default_tokenizer()), library, texts)
    library = type(library).from_str(library.to_str())  # a copy: the other tests share it
    library.add_tokens(["x.y", "1-a"])  # held together
    library.save(str(tmp_path / "added.json"))
    encoder = encoding.Encoder(str(tmp_path / "added.json"))
    assert not encoder.marks[[ord(m) for m in ".-|"]].any() and encoder.marks[ord(",")]
    assert same_ids(encoder, library, texts)


def test_no_cut_before_marks_where_words_may_span_it(library, tmp_path):
    from tokenizers import AddedToken, pre_tokenizers

    library = type(library).from_str(library.to_str())  # a copy: the other tests share it
    library.add_tokens([AddedToken("Zs", single_word=True)])
    library.save(str(tmp_path / "single.json"))
    assert encoding.Encoder(str(tmp_path / "single.json")).marks is None
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    assert encoding.ending_marks(library) is None
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    assert encoding.ending_marks(library) is None


# 6


def test_url_rules_equal_brute_force(ready):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("Net", "/fr", "block"), ("", "/", "block"), (None, "/", "block")]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y", "http://a.example.com/en/", "http://example.com/en", "http://example.com", "http://x.net/fr",
            "http://x.net/es/#a", "http://xexample.com/en/", "http://net/es/", "x://a://b.com/", "http://a..com/\nz", "http://b.org/en/", "http://b.org/en/"]
    df = ready.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("block", F.lit(1)).withColumn("verdict", F.lit("x"))
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h.lower() + p, v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want.append((i, host, path, best[1], best[2]))
    got = url_rules.judge_urls(df, ready.createDataFrame(rules, "host string, path string, verdict string"))
    assert sorted(tuple(r) for r in got.collect()) == want
    none = ready.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_rules.judge_urls(df, none).collect()} == {"allow"}


# 7


def plain_hits(text, items, window):
    words = decontaminate.word_bytes(text or "")
    hit, named = set(), set()
    for item, of in items:
        w = decontaminate.word_bytes(of or "")
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            for at in range(len(words) - n + 1):
                if words[at:at + n] == w[i:i + n]:
                    hit.update(range(at, at + n))
                    named |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(named)


@pytest.mark.parametrize("pattern_bytes", [decontaminate.PATTERN_BYTES, 300])  # 300: several passes
def test_decontamination_equals_brute_force(ready, pattern_bytes):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "Bb", "c1", "é", "dd", "漢"])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(12)] + [(3, "a bb"), (None, "c1 c1 c1"), (50, None), (10, "a bb")]
    texts = [None, "", "--", *[rng.choice([", ", " ", "\n"]).join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]]
    bench = ready.createDataFrame(items, "item_id long, text string").withColumn("pattern", F.lit(1))
    got = by_id(decontaminate.find_benchmark(documents(ready, texts), bench, window=4, pattern_bytes=pattern_bytes), "n_words", "n_hit", "items")
    assert got == {i: plain_hits(t, items, 4) for i, t in enumerate(texts)}


def test_decontamination_of_nothing(ready):
    none = ready.createDataFrame([], "item_id long, text string")
    assert by_id(decontaminate.find_benchmark(documents(ready, ["a b"]), none), "n_words", "n_hit") == {0: (2, 0)}
    assert decontaminate.find_benchmark(empty(ready), none).count() == 0


# 8


def test_language_on_held_out_rows(ready):
    rng = random.Random(6)
    syllables = {"xx": ["ka", "to", "mi"], "yy": ["str", "eng", "olf"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(12)), lang) for i in range(200) for lang in [("xx", "yy")[i % 2]]]
    rows += [(500, None, "xx"), (501, "12 --", "yy"), (502, "kato", None)]
    df = ready.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("z"))
    got = by_id(language.identify(df, language.fit(language.training_rows(df))), "lang_pred", "score", "entropy")
    assert all(got[i][0] == ("xx", "yy")[i % 2] for i in range(200)) and all(0 <= s <= 1 for _, s, _ in got.values())
    assert got[500] == got[501] == ("und", 0.0, None) and got[502][0] == "xx"


def test_an_unlearnt_language_is_rejected_whatever_its_share(ready):
    import corpus_pipeline

    rng = random.Random(8)
    syllables = {"xx": ["ka", "to", "mi", "su"], "yy": ["str", "eng", "olf", "ach"], None: ["qua", "vez", "dij", "pnu", "wyb"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang, rng.randint(5, 60)), lang) for i in range(600) for lang in [("xx", "yy", None)[i % 3]]]
    rows += [(1000 + i, text(lang, 1 + i % 3), lang) for i in range(60) for lang in [("xx", "yy")[i % 2]]]
    kept = corpus_pipeline.identify_language(ready, ready.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i, _, lang in rows if lang]


def test_marks_without_a_letter_have_no_language(ready):
    rows = [(i, "some words of a language " * 5, "en") for i in range(20)] + [(100, "\u0301\u0308 \u0301", None), (101, "e\u0301", None)]
    df = ready.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language.identify(df, language.fit(language.training_rows(df))), "lang_pred", "score")
    assert got[100] == ("und", 0.0) and got[101][0] == "en"


def test_language_without_training_rows(ready):
    model = language.fit(empty(ready))
    assert by_id(language.identify(documents(ready, ["abc"]), model), "lang_pred") == {0: ("und",)}


def test_a_rare_language_stays_in_a_pruned_model(ready):
    rng = random.Random(15)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)), "big") for i in range(40)] + [(100, "rstu vwxy zrst", "rare")] * 2
    df = ready.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, max_grams=2000)
    assert model["langs"] == ["big", "rare"] and len(model["orders"][-1][0]) <= 2100
    got = by_id(language.identify(documents(ready, ["rstu zrst", "abcd fghi"]), model), "lang_pred")
    assert got == {0: ("rare",), 1: ("big",)}
    rest = [np.exp(language.log_probabilities(model, language.codes_of(["abc" + c]))[0, 0]) for c in "abcdefghij rstuvwxyz?"]
    assert sum(rest) == pytest.approx(1, abs=0.01)


def test_a_model_over_its_bound_scores_by_all_its_grams(ready):
    rng = random.Random(16)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(i, text(("abcdefgh", "efghij\u00e9\u4e00")[i % 2], 80), ("xx", "yy")[i % 2]) for i in range(30)]
    df = ready.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = documents(ready, [text("abcdefghij\u00e9\u4e00", n) for n in (1, 3, 40)] + ["", "12", "q", None, text("efgh", 30)] * 2)
    whole = by_id(language.identify(asked, language.fit(df)), "lang_pred", "score", "entropy")
    limits = {r["lang"]: (r["centre"], r["spread"]) for r in language.rejection_limits(df, language.fit(df)).collect()}
    for most in (2, 500):
        model = language.fit(df, max_grams=most)
        got = by_id(language.identify(asked, model), "lang_pred", "score", "entropy")
        assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in whole.items()}
        for i, w in whole.items():
            assert got[i][1] == pytest.approx(w[1], abs=1e-3) and got[i][2] == (None if w[2] is None else pytest.approx(w[2], abs=1e-4))
    cut = {r["lang"]: (r["centre"], r["spread"]) for r in language.rejection_limits(df, model).collect()}
    assert cut.keys() == limits.keys() and all(cut[k] == pytest.approx(limits[k], abs=1e-3) for k in cut)


def test_probabilities_of_a_context_sum_to_one():
    grams = [("xx", g, n) for g, n in (("abca", 3), ("abcb", 1), ("bcab", 2), ("cabc", 4), ("abcc", 1))]
    model = language.build_model(grams)
    total = sum(np.exp(language.log_probabilities(model, language.codes_of(["abc" + c]))[0, 0]) for c in "abc")
    rest = np.exp(language.log_probabilities(model, language.codes_of(["abcz"]))[0, 0])
    assert total + rest == pytest.approx(1, abs=1e-3)


# 9


def test_edited_fingerprints(ready):
    texts = [t for t in odd_texts() if t is None or len(t) < 5000][:40]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 2
    df = ready.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(1)).withColumn("id", F.lit("a"))
    order = [t or "" for _, t in sorted(rows, key=lambda r: r[0])]
    want = []
    for i, t in enumerate(order):
        after, q = order[(i + 1) % len(order)], len(t) // 4
        want.append(hashlib.sha256((t[:len(t) - q] + after[:q]).encode()).hexdigest())
    got = [r[0] for r in fingerprint.edited_fingerprints(df).select(F.sha2("edited_text", 256)).collect()]
    assert sorted(got) == sorted(want)
    assert fingerprint.edited_fingerprints(empty(ready)).count() == 0


def test_sketches_estimate_containment(ready):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(5000)]
    whole = [rng.choice(words) for _ in range(6000)]
    df = ready.createDataFrame([(" ".join(whole), " ".join(whole[:1500]), " ".join(rng.choice(words) for _ in range(900)))], "a string, b string, c string")
    s = {n: fingerprint.sketch(F.col(n)) for n in "abc"}
    ab, ac, aa, empties, one = df.select(fingerprint.likeness(s["a"], s["b"]), fingerprint.likeness(s["a"], s["c"]), fingerprint.likeness(s["a"], s["a"]),
                                         fingerprint.likeness(fingerprint.sketch(F.lit(" ")), fingerprint.sketch(F.lit(""))),
                                         fingerprint.likeness(fingerprint.sketch(F.lit("x")), s["a"])).first()
    assert (ab, ac, aa, empties, one) == (1, 0, 1, 1, 0)
    kept = df.select(F.size(s["a"])).first()[0]
    assert 0.2 < kept / (6000 - 4) < 0.3


# pipeline


ODD_NAMES = ["doc_id", "text", "lang", "source", "n_chars", "my col", "x.y", "a-b", "a:b", "_copies", "_text_mark", "document", "row", "b`q"]


def corpus(spark, rows):
    """Rows (doc_id, text, lang) as documents with columns of odd names."""
    from pyspark.sql import types as T

    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType(), *[T.StringType()] * (len(ODD_NAMES) - 5)]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(ODD_NAMES, kinds)])
    return spark.createDataFrame([(i, t, lang, None, len(t or ""), *"abcdefghi") for i, t, lang in rows], schema)


def corpus_rows():
    rng = random.Random(8)
    pools = {"en": "abcdefgh", "xx": "stuvwxyz"}
    rows = []
    for i in range(160):
        lang = ("en", "xx")[i % 2]
        words = ["".join(rng.choice(pools[lang]) for _ in range(rng.randint(2, 7))) for _ in range(60)]
        rows.append((i, " ".join(words), lang if i % 5 else None))
    rows += [(200, None, "en"), (201, "", None), (202, "12 34", "en"), (None, rows[2][1] + " aaa", "en"), (203, rows[4][1], "en"), (4, rows[4][1], "en"), (204, "abc def " * 20_000, "en")]
    return rows


@pytest.mark.parametrize("rows", [[], corpus_rows()], ids=["empty", "odd"])
def test_each_stage_takes_odd_names_and_rows(ready, tmp_path, rows):
    import corpus_pipeline

    folder = str(tmp_path)
    corpus(ready, rows).write.parquet(f"{folder}/documents.parquet")
    ready.createDataFrame([(i, i % 4 // 2, 0) for i in range(0, 160, 3) if rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    ready.createDataFrame([("q", corpus_rows()[8][1]), ("n", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = ready.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(ready, docs, folder)
        assert out.columns == ODD_NAMES, name
        kept = out.select("doc_id", "text", "`x.y`", "`b``q`").collect()
        assert all((r[2], r[3]) == ("b", "i") for r in kept)
        if name == "near_duplicates" and rows:
            texts = [r["text"] for r in kept]
            assert texts.count(corpus_rows()[4][1]) == 1 and corpus_rows()[2][1] + " aaa" not in texts
        if name == "decontamination" and rows:
            assert corpus_rows()[8][1] not in [r["text"] for r in kept] and len(kept) > 100
    whole = corpus_pipeline.run(ready, folder)
    assert (whole.count() > 0) == bool(rows)


def test_forest_roots_equal_walking_up(ready):
    forest_roots = graph.forest_roots

    rng = random.Random(5)
    parent = {b: b - 1 for b in range(1, 12)} | {b: 20 for b in range(21, 60)} | {b: rng.randrange(60, b) for b in range(61, 120) if b % 7}
    df = ready.createDataFrame([(a, b) for b, a in parent.items()], "a long, b long")

    def top(x):
        while x in parent:
            x = parent[x]
        return x

    nodes = set(parent) | set(parent.values())
    assert sorted(map(tuple, forest_roots(df).collect())) == sorted((x, top(x)) for x in nodes)
    assert forest_roots(df.limit(0)).count() == 0
