"""The pipeline operators against brute force, on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    arc_convert,
    benchmark_filter,
    bitplane_store,
    components,
    grouped_packing,
    histogram_topk,
    host_reputation,
    jaccard_join,
    line_templates,
    separator_scan,
    shared_passages,
    shingles,
    storage,
    toxic_segments,
)
from tidemark.llm.queries import END_OF_TEXT, tokenizer_path

pytest.importorskip("public_tokenizers")

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(6000))
TEXTS = [
    (1, "The cat sat on the mat, and then it left again."),
    (2, "the CAT sat on the mat, and then it left again."),
    (3, None),
    (4, ""),
    (5, "  \t\n "),
    (6, "one two"),
    (7, "One  Two"),
    (8, LONG),
    (9, LONG.replace("w500x", "changed")),
    (10, "naïve café — 日本語 テスト <|endoftext|> it's 12,345"),
    (11, "x"),
    (11, "x"),
    (11, "another text under the same number as before"),
    (None, "a text without any number at all here"),
]
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, and a column whose name the operators use themselves."""
    return spark.createDataFrame(TEXTS, DOCS).withColumn("n", F.lit("clash")).withColumn("row_key", F.lit(0)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


# 1: separator scan


def flat(tmp_path, name, ids):
    (tmp_path / name).write_bytes(np.asarray(ids, dtype="<u2").tobytes())
    return str(tmp_path / name)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_documents_of_flat_files(spark, tmp_path, block):
    files = {"a": [5, 0, 0, 7, 8, 9, 0, 4], "b": [0], "c": [], "d": [1, 2, 3], "e": [1] * 20 + [0, 2, 0]}
    paths = {flat(tmp_path, name, ids): ids for name, ids in files.items()}
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    found = defaultdict(list)
    for r in separator_scan.count_tokens(frame, 0, 2, block).collect():
        found[r["path"]].append((r["doc_no"], r["start"], r["n_tokens"], r["ended"]))
    for path, ids in paths.items():
        want, start = [], 0
        for at in [i for i, x in enumerate(ids) if x == 0]:
            want.append((len(want), start, at - start, True))
            start = at + 1
        if start < len(ids):
            want.append((len(want), start, len(ids) - start, False))
        assert sorted(found[path]) == want


def test_half_an_id_is_an_error(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        separator_scan.count_tokens(spark.createDataFrame([(str(tmp_path / "x"),)], "path string"), 0).collect()


def test_flat_files_hold_every_document(docs, empty):
    rows = separator_scan.write_flat(docs, tokenizer_path(), END_OF_TEXT)
    counted = rows.join(separator_scan.count_tokens(rows.select("path"), END_OF_TEXT, 2, 100), ["path", "doc_no"])
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    want = sorted((i is None, i or 0, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in counted.collect()) == want
    rows = separator_scan.write_flat(empty, tokenizer_path(), END_OF_TEXT)
    assert separator_scan.count_tokens(rows.select("path"), END_OF_TEXT).count() == 0


# 2: archives


def test_arc_headers_by_version():
    import io

    for version in (1, 2):
        data = arc_convert.arc_head("x.arc", "20010203040506", version)
        data += arc_convert.arc_bytes("http://a.b/c d\n", "20010203040506", b"HTTP/1.0 200 OK\r\n\r\nbody\n\n1 2", version)
        data += b"no header line\n"
        data += arc_convert.arc_bytes("dns:a.b", "20010203040506", b"", version, "text/dns")
        data += arc_convert.arc_bytes("http://cut/", "20010203040506", b"0123456789", version)[:-6]
        found = list(arc_convert.parse_arc(io.BufferedReader(io.BytesIO(data))))
        assert [(r.url, r.declared, len(r.block)) for r in found] == [("http://a.b/c%20d%0A", 28, 28), ("dns:a.b", 0, 0), ("http://cut/", 10, 5)]
        assert found[0].payload() == (b"HTTP/1.0 200 OK\r\n\r\n", b"body\n\n1 2")
        fields, block = next(arc_convert.parse_warc(io.BufferedReader(io.BytesIO(arc_convert.to_warc(found[2], "x", None)))))
        assert fields["warc-truncated"] == "length" and block == b"01234" and fields["warc-type"] == "resource"


def test_archives_round_trip(spark):
    import base64

    pages = [(i, f"http://h{i}.org/ a?b", "same" if i % 3 else f"page {i} é") for i in range(40)]
    pages += [(100, None, None), (101, "", ""), (7, "http://h7.org/ a?b", "same"), (None, "u", "alone")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    archives = arc_convert.write_arc(frame, roll=500)
    assert archives.count() > 5
    records = storage.park(arc_convert.survey(archives), "records")
    got = arc_convert.read_warc(arc_convert.convert(archives, records)).collect()
    top = defaultdict(lambda: -1)
    for i, _, html in pages:
        top[html or ""] = max(top[html or ""], -1 if i is None else i)
    kinds = defaultdict(list)
    for r in got:
        kinds[r["page_id"]].append((r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
    assert len(got) == len(pages)
    for i, _, html in pages:
        body = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        last = top[html or ""] in (i, -1)
        want = (len(body), sha, "response" if last else "revisit", None if last else top[html or ""])
        assert kinds[i][0] == want and all(x == want for x in kinds[i])
    assert len(kinds[7]) == 2
    none = frame.limit(0)
    archives = arc_convert.write_arc(none)
    assert arc_convert.read_warc(arc_convert.convert(archives, storage.park(arc_convert.survey(archives), "r"))).count() == 0


# 3: line templates


def test_recurring_templates_go_but_for_the_first(spark):
    note = "User {} logged in from the office at night"
    rows = [(i, f"Only document {i} has this very line of text\n{note.format('u%d' % i)}\nshort one\n") for i in range(6)]
    rows += [(6, None), (7, ""), (8, note.format("u1")), (8, note.format("u1")), (None, "nothing here recurs in any other document")]
    frame = spark.createDataFrame(rows, DOCS).withColumn("n_dropped", F.lit("kept")).drop("n_dropped")
    found = line_templates.drop_lines(frame).collect()
    left = {r["doc_id"]: r["text"] for r in found}
    assert len(found) == len(rows)
    first = [r for r in found if r["doc_id"] == 0][0]
    assert first["text"] == rows[0][1] and first["n_dropped"] == 0
    # the lead of the first line has the number, so its documents share a template as well
    assert left[1] == "short one\n" and left[8] == "" and left[6] is None and left[7] == ""
    assert left[None] == rows[-1][1]


def test_few_documents_or_tokens_do_not_make_a_template(spark):
    rows = [(i, "the same line in two documents only\na b c d") for i in range(2)] + [(i, "a b c d") for i in range(2, 9)]
    frame = spark.createDataFrame(rows, DOCS)
    assert {r["text"] for r in line_templates.drop_lines(frame).collect()} == {rows[0][1], "a b c d"}
    assert line_templates.drop_lines(frame.limit(0)).count() == 0


def said(*seeds):
    """60 words that no other seeds share."""
    return " ".join(f"{a}{b}" for seed in seeds for a in "bcdfgh" for b in (f"{seed}{x}" for x in "aeiouyklmn"))


def line_dedup(spark, rows):
    frame = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text"))
    found = corpus_pipeline.line_dedup(spark, frame, "").collect()
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found)
    return {r["doc_id"]: r["text"] for r in found}


def test_long_lines_of_two_documents_go(spark):
    long, brief = said("p"), "the same brief line in two documents"
    rows = [(i, f"{said('own' + 'xyz'[i])}\n{long}\n{brief}") for i in range(2)] + [(2, said("q"))]
    left = line_dedup(spark, rows)
    assert left == {0: rows[0][1], 1: f"{said('owny')}\n{brief}", 2: rows[2][1]}


def test_templates_with_variable_words_all_over_the_line_go(spark):
    words = said("p").split()

    def line(i, places):  # one variable word in each sixth of the line and more
        return " ".join(f"var{'uvwxyz'[i]}" if at in places else word for at, word in enumerate(words))

    slots = {i: line(i, {8, 18, 27, 36, 45, 55}) for i in range(2)}
    noise = {i: line(i, {5 + i, 16 + i, 26 + 2 * i, 37 + i, 44 + i, 58 - i}) for i in range(2, 6)}
    apart = " ".join(words[:4] + [w[::-1] if k % 3 else w for k, w in enumerate(words[4:])])  # a third of the tokens
    texts = {**slots, **noise, 6: apart}
    left = line_dedup(spark, [(i, f"{said('own' + 'abcdefg'[i])}\n{texts[i]}") for i in texts])
    assert [i for i in texts if "\n" in left[i]] == [0, 6]


def test_unrelated_lines_before_do_not_split_a_template(spark):
    """Ten documents with one line of 30 tokens, six of them variable, behind three lines that share 9, 9 and 8 of the
    constant ones in their places."""
    words = said("p").split()[:30]
    own = lambda i, k: f"{'abcdefghijklm'[i]}{'nopqrstuvwxyzabcdefghijklmnopqr'[k]}only"
    earlier = [set(range(4, 13)), set(range(13, 22)), set(range(22, 30))]
    lines = [" ".join(w if k < 4 or k in earlier[i] else own(i, k) for k, w in enumerate(words)) for i in range(3)]
    for i in range(3, 13):
        places = {4 + (7 * i + 4 * k) % 26 for k in range(6)}
        lines.append(" ".join(own(i, k) if k in places else w for k, w in enumerate(words)))
    left = line_dedup(spark, [(i, f"{said('own' + 'abcdefghijklm'[i])}\n{line}") for i, line in enumerate(lines)])
    assert [i for i in range(13) if "\n" in left[i]] == [0, 1, 2, 3]


def test_words_of_one_32_bit_hash_do_not_make_a_template(spark):
    frame = spark.createDataFrame([(i, f"they all begin alike {w}") for i, w in enumerate(["hgija", "hgija", "cfefif"])], DOCS)
    assert frame.select(F.hash(F.array(F.element_at(F.split("text", " "), -1)))).distinct().count() == 1
    assert all(r["n_dropped"] == 0 for r in line_templates.drop_lines(frame).collect())


def test_no_column_name_clashes(spark):
    """Columns of the names that the operators use themselves stay as they were."""
    rows = [(i, f"{said('p')}\nown {'abcd'[i]} only") for i in range(4)]
    own = {c: f"own {c}" for c in ("__key", "key", "_KEY", "gone", "dropped", "row_key", "spans", "hits", "of", "no", "component")}
    frame = spark.createDataFrame(rows, DOCS)
    for c, value in own.items():
        frame = frame.withColumn(c, F.lit(value))
    frame = frame.withColumn("n_dropped", F.lit("own")).withColumn("n_passages", F.lit("own")).withColumn("n_chars", F.length("text"))
    benchmark = spark.createDataFrame([("i", said("p"))], "item_id string, text string")
    for left, number in [
        (line_templates.drop_lines(frame, min_docs=2), "n_dropped"),
        (shared_passages.drop_passages(frame, n=20), "n_passages"),
        (benchmark_filter.decontaminate(frame, benchmark, remove="spans"), None),
        (benchmark_filter.decontaminate(frame, benchmark.limit(0)), None),
        (jaccard_join.one_of_each(frame), None),
        (corpus_pipeline.line_dedup(spark, frame, ""), None),
    ]:
        assert sorted(left.columns) == sorted(frame.columns)
        found = [r.asDict() for r in left.collect()]
        assert found and all(r[c] == value for r in found for c, value in own.items())
        assert all(r["n_dropped"] == "own" or number == "n_dropped" and r["n_dropped"] == (r["doc_id"] > 0) for r in found)
        assert all(r["n_passages"] == "own" or number == "n_passages" and r["n_passages"] == (r["doc_id"] > 0) for r in found)


def brute_cut(rows, n):
    """Which words of each text lie in windows that a text before has too."""
    listed = {i: [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w] for i, text in rows}
    gone, seen = {i: set() for i in listed}, {}
    for i in sorted(listed):
        for at in range(len(listed[i]) - n + 1):
            if seen.setdefault(tuple(listed[i][at : at + n]), i) != i:
                gone[i] |= set(range(at, at + n))
    return {i: [w for k, w in enumerate(listed[i]) if k not in gone[i]] for i in listed}


@pytest.mark.parametrize("segment", [7, 4096])
def test_passages_match_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(shared_passages, "SEGMENT", segment)
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abc"), 2)) for _ in range(400)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.integers(1, 4)):
            text += [f"{rng.choice(list('abcde'))}{rng.choice(list('abcde'))}" for _ in range(rng.integers(0, 30))]
            at = rng.integers(0, 350)
            text += pool[at : at + rng.integers(5, 50)]
        rows.append((i, "(" + " ".join(w.upper() if rng.random() < 0.1 else w + rng.choice(["", ",", ".\n"]) for w in text)))
    want = brute_cut(rows, 12)
    frame = spark.createDataFrame(rows + rows[:2] + [(99, None), (98, "")], DOCS)
    found = shared_passages.drop_passages(frame, n=12).collect()
    assert len(found) == len(rows) + 4 and sum(r["n_passages"] > 0 for r in found) > 10
    for r in found:
        if r["doc_id"] < 90:
            assert [w for w in re.split(r"[^a-z0-9]+", r["text"].lower()) if w] == want[r["doc_id"]]
        else:
            assert r["text"] == {99: None, 98: ""}[r["doc_id"]] and r["n_passages"] == 0


def test_passages_inside_paragraphs_go(spark):
    rows = [(i, f"{said('own' + 'xyz'[i])} {'word' + 'xyz'[i]} {said('p')}. {said('end' + 'xyz'[i])}") for i in range(3)] + [(3, f"({said('p')}")]
    left = line_dedup(spark, rows)
    assert left[0] == rows[0][1] and set(left) == {0, 1, 2}
    assert left[2] == f"{said('ownz')} wordz {said('endz')}"


# 4: top k


def brute_top(vectors, queries, k):
    out = {}
    for q in queries:
        scores = [(-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        out[q] = [(rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("scale, block", [(3, 4), (60, 100), (3_000_000, 3)])
def test_top_k_is_exact(spark, scale, block):
    rng = np.random.default_rng(scale)
    vectors = {i: rng.integers(-scale, scale + 1, 5 if i % 7 else 3) for i in range(-10, 90)}
    for i in range(60, 80):
        vectors[i] = vectors[61]  # ties beyond k
    rows = [(i, v.tolist()) for i, v in vectors.items()] + [(None, [1, 2, 3]), (500, None)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("score", F.lit(1)).repartition(4)
    got = defaultdict(list)
    for r in histogram_topk.top_k(frame, F.col("vec_id") % 20 == 0, 6, block).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == brute_top(vectors, [i for i in vectors if i % 20 == 0], 6)


def test_scores_beyond_a_long_are_the_nearest_one(spark):
    big, longest = 10**17 * 64, 2**63 - 1
    vectors = {0: [big, 3], 1: [big, 1], 2: [-big, 5], 3: [1, 10**9], 4: [1, -7], 5: [big, 2], 6: [0, 4]}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, vector array<long>")
    scores = [(-max(-longest, min(longest, sum(a * b for a, b in zip(vectors[0], v)))), i) for i, v in vectors.items() if i]
    want = [(rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:5])]
    found = histogram_topk.top_k(frame, F.col("vec_id") == 0, 5).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == want and want[0][2] == want[1][2] == longest
    far = spark.createDataFrame([([1e300, -1e300, 1e17],)], "v array<double>")
    assert far.select(histogram_topk.quantized("v").alias("w")).first()["w"] == [longest, -longest, big]


def test_top_k_of_few(spark):
    frame = spark.createDataFrame([(0, [1, 1]), (1, [2, -5]), (20, [0, 0])], "vec_id long, vector array<long>")
    got = sorted(tuple(r) for r in histogram_topk.top_k(frame, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 20, 0), (0, 2, 1, -3), (20, 1, 0, 0), (20, 2, 1, 0)]
    assert histogram_topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_vectors_that_take_no_part(spark):
    rows = [(1, [0.5, -0.01]), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, None), (6, [])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<float>").select("vec_id", histogram_topk.quantized("v").alias("w"))
    assert {r["vec_id"]: r["w"] for r in frame.collect()} == {1: [32, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


# 5: id planes


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("top", [0, 1, 255, 256, 49407, 2**32 - 1])
def test_planes_round_trip(kind, top):
    ids = np.random.default_rng(top).integers(0, top + 1, 1001, dtype=np.uint64).astype("<u4")
    ids[-1] = top
    assert (bitplane_store.from_planes(bitplane_store.to_planes(ids, kind), len(ids), kind) == ids).all()


def test_a_stretch_of_ids_through_the_chunk_index():
    sink = pa.BufferOutputStream()
    writer = bitplane_store.PlaneWriter(sink, 64, "bit")
    ids = np.arange(1000, dtype=np.uint16)
    for at in range(0, 1000, 37):
        writer.add(at, ids[at : at + 37])
    writer._target, closed = _Unclosed(sink), writer.close
    closed()
    reader = bitplane_store.PlaneReader(pa.BufferReader(sink.getvalue()))
    assert np.concatenate(list(reader.ids(100, 500))).tolist() == list(range(100, 500))
    assert len(reader.chunks) == 16 and reader.lengths.sum() == 1000


class _Unclosed:
    def __init__(self, sink):
        self.write = sink.write

    def close(self):
        pass


@pytest.mark.parametrize("kind, shard_bytes", [("byte", 1 << 30), ("bit", 2000)])
def test_ids_are_read_back_in_order(docs, encoded, kind, shard_bytes):
    files = bitplane_store.write_ids(docs, tokenizer_path(), 1, block=100, kind=kind, shard_bytes=shard_bytes)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in bitplane_store.read_documents(files).collect())
    start, seen = 0, []
    for at, doc_id, n, _ in got:
        assert at == start
        start += n
        seen.append(doc_id)
    assert seen == sorted(seen, key=lambda i: -1 if i is None else i)
    want = sorted((-1 if i is None else i, len(encoded(t)) + 1, crc([*encoded(t), 1])) for i, t in TEXTS)
    assert sorted((-1 if d is None else d, n, c) for _, d, n, c in got) == want


def test_no_documents_make_no_file(empty):
    files = bitplane_store.write_ids(empty, tokenizer_path())
    assert files.count() == 0 and bitplane_store.read_documents(files).count() == 0


# 6: Jaccard join


def word_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(rows):
    sets = [word_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[find(a)].append(i)
    return [
        (i, len(sets[a]), i if not sets[a] else min((x for x in least[find(a)] if x is not None), default=None))
        for a, (i, _) in enumerate(rows)
    ]


def check_join(frame, rows):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join_documents(frame).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_join_of_awkward_rows(docs, empty):
    check_join(docs, TEXTS)
    assert jaccard_join.join_documents(empty).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (1, 2)").count() == 1 and kept.filter("text = 'x'").count() == 1


@pytest.mark.parametrize("small", [64, 3])
def test_join_of_families_with_a_shared_passage(spark, monkeypatch, small):
    """Chains of ever farther copies, a passage that all share, and (small=3) the recursion by pivots."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for family in range(6):
        words = [f"f{family}n{rng.integers(0, 10_000)}" for _ in range(90)]
        for copy in range(14):
            at = int(rng.integers(0, 90))
            words = [*words[:at], f"e{len(rows)}", *words[at + 1 :]]
            rows.append((len(rows) * 3 + 1, " ".join([*words[:40], *(passage if copy % 2 else []), *words[40:]])))
    check_join(spark.createDataFrame(rows, DOCS).repartition(5), rows)


def test_join_compares_few_pairs_of_a_large_family(spark, monkeypatch):
    """Texts that are linked in the end by way of others are not compared pair by pair."""
    handed, plausible = [], jaccard_join._plausible

    def counted(pairs, *rest):
        handed.append(pairs.count())
        return plausible(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_plausible", counted)
    rng = np.random.default_rng(3)
    origin, rows = [f"o{i}" for i in range(100)], []
    for i in range(60):
        at = set(rng.choice(100, 3, replace=False).tolist())
        rows.append((i, " ".join(f"e{i}x{k}" if k in at else w for k, w in enumerate(origin))))
    check_join(spark.createDataFrame(rows, DOCS).repartition(3), rows)
    assert sum(handed) < 6 * len(rows)


def test_shingles_follow_the_words():
    texts = [t for _, t in TEXTS] + ["a b c d e f", "A B\tC d  e\rf", "a b c d e", "ab c", "a bc"]
    found = shingles.shingle_sets(pa.array(texts, pa.string()))
    words = [word_set(t) for t in texts]
    for i, a in enumerate(words):
        assert len(found[i]) == len(a)
        for j, b in enumerate(words):
            assert len(np.intersect1d(found[i], found[j])) == len(a & b)


def test_components_of_a_graph(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(-50, 50, (45, 2))] + [(200 + i, 201 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["vertex"]: r["component"] for r in got} == {a: find(a) for a in parent} and len(got) == len(parent)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 7: packing


@pytest.mark.parametrize("seed", range(8))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    low = int(rng.integers(1, 900))
    sizes = rng.integers(low, 2049, int(rng.integers(1, 3000)))
    values, counts = np.unique(sizes, return_counts=True)
    plan = grouped_packing.best_plan(dict(zip(values.tolist(), counts.tolist())), 2048, groups=12)
    used = defaultdict(list)
    for n, first, count, sequence, q, offset in plan.tolist():
        for k in range(count):
            used[sequence + k // q].append((offset + k % q * n, n))
    assert sum(len(v) for v in used.values()) == len(sizes)
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(n for v in used.values() for _, n in v) == sorted(sizes.tolist())
    assert len(used) >= -(-sizes.sum() // 2048)


def test_pack_documents(docs, empty, encoded):
    got = grouped_packing.pack_documents(docs, tokenizer_path(), 0, 50).collect()
    want = []
    for i, text in TEXTS:
        ids = [*encoded(text), 0]
        want += [(i or -1, p, at, len(ids[at : at + 50]), crc(ids[at : at + 50])) for p, at in enumerate(range(0, len(ids), 50))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *(n for _, n in sorted(places))])[:-1].tolist()
        assert sum(n for _, n in places) <= 50
    assert grouped_packing.pack_documents(empty, tokenizer_path()).count() == 0


# 8: host reputation


def test_rules_and_reputation(spark):
    urls = [
        (1, "http://A.Example.org/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
        (2, "https://example.org", "example.org", "", None, "allow"),
        (3, "https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        (4, "nothing", "", "", None, "allow"),
        (5, None, "", "", None, "allow"),
        (6, "x://bad.net/p://q", "bad.net", "/p://q", None, "block"),
        (7, "x://good.net?a/b", "good.net", "", None, "allow"),
        (7, "x://good.net?a/b", "good.net", "", None, "allow"),
        (None, "s://www.bad.net/\nk", "www.bad.net", "/\nk", None, "block"),
    ]
    pages = spark.createDataFrame([u[:2] for u in urls], "page_id long, url string").withColumn("verdict", F.lit(""))
    seen = [("bad.net", 1)] * 60 + [("www.bad.net", 1)] * 60 + [("good.net", 0)] * 60 + [("", None), ("other.com", None)] + [("fine.com", 0)] * 600
    outcomes = spark.createDataFrame(seen, "host string, bad int")
    rules = [("block", "example.org/es/"), ("allow", "org/")]
    got = [tuple(r)[:5] for r in host_reputation.judge(pages, outcomes, rules).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == [(u[0], u[2], u[3], u[4], u[5]) for u in urls]
    assert host_reputation.judge(pages, outcomes.limit(0), rules).filter("verdict = 'block'").count() == 1
    assert host_reputation.judge(pages.limit(0), outcomes, rules).count() == 0


def test_shrinkage_goes_from_host_to_suffix(spark):
    seen = [(f"h{i}.d{i % 3}.org", int(k < 2 * (i % 3))) for i in range(12) for k in range(20)] + [("new.d2.org", None), ("far.net", None)]
    got = {r["host"]: r for r in host_reputation.reputation(spark.createDataFrame(seen, "host string, bad int")).collect()}
    assert got["new.d2.org"]["n"] == 0
    assert got["new.d2.org"]["mean"] > got["far.net"]["mean"] * 0.9
    assert all(0 <= r["mean"] <= 1 and r["bound"] < r["mean"] for r in got.values())


# 9: toxic segments


@pytest.mark.parametrize("seed", range(40))
def test_segments_are_the_maximal_ones(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(-0.2, 1, int(rng.integers(0, 40)))

    def best(low, high):
        found = max(((scores[i:j].sum(), i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0, 0, 0))
        return best(low, found[1]) + [found[1:]] + best(found[2], high) if found[0] > 0 else []

    assert [(a, b) for a, b, _ in toxic_segments.segments(scores)] == best(0, len(scores))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    insults = ["dolt", "oaf", "cur", "knave", "lout"]
    rows = []
    for i in range(900):
        text = rng.choice(words, int(rng.integers(20, 300))).tolist()
        if i % 6 == 0:
            at = int(rng.integers(0, len(text)))
            text[at:at] = rng.choice(insults, 6).tolist()
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    return spark.createDataFrame(rows, DOCS + ", toxic int"), rows


def test_held_out_accuracy(labelled):
    frame, rows = labelled
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", "toxic")
    model = toxic_segments.fit(docs, labels)
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    scored = {r["doc_id"]: r for r in toxic_segments.score(docs, model).collect()}
    assert sum((scored[i]["score"] >= 0.5) == bool(rows[i][2]) for i in held) >= 0.97 * len(held)
    span = scored[0]["passages"][0]
    assert set(rows[0][1][span["start"] : span["end"]].split()) & {"dolt", "oaf", "cur", "knave", "lout"}
    kept = toxic_segments.reject(frame, model)
    assert kept.columns == frame.columns and kept.filter("toxic = 0").count() >= 0.99 * 750
    assert kept.filter("toxic = 1").count() <= 0.05 * 150
    # labels of fold 0 teach nothing
    lies = labels.withColumn("toxic", F.when(toxic_segments.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxic_segments.fit(docs, lies) == model


def test_scores_of_awkward_rows(docs, empty, labelled):
    frame, _ = labelled
    model = toxic_segments.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    got = toxic_segments.score(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxic_segments.score(empty, model).count() == 0
    one_kind = frame.select("doc_id", F.lit(1).alias("toxic"))
    assert all(r["score"] > 0.99 for r in toxic_segments.score(docs, toxic_segments.fit(frame, one_kind)).collect())
    none = toxic_segments.fit(docs, one_kind.limit(0))
    assert all(r["score"] < 0.01 for r in toxic_segments.score(docs, none).collect())


# 10: benchmark decontamination


def brute_hits(text, items, n=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, ids = set(), set()
    for item, other in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), other or ""))
        k = min(n, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                if item is not None:
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("segment,broadcast", [(4096, 250_000), (16, 250_000), (4096, 0), (16, 0)])
def test_hits_match_brute_force(spark, monkeypatch, segment, broadcast):
    monkeypatch.setattr(benchmark_filter, "SEGMENT", segment)
    monkeypatch.setattr(benchmark_filter, "BROADCAST_WINDOWS", broadcast)
    rng = np.random.default_rng(7)
    vocabulary = ["Ab", "cd", "é", "x1", "q"]
    items = [(i, ", ".join(rng.choice(vocabulary, int(rng.integers(0, 22))))) for i in range(25)]
    items += [(30, None), (31, "..."), (None, "zz yy"), (32, "zz")]
    rows = []
    for i in range(60):
        words = rng.choice(vocabulary, int(rng.integers(0, 90))).tolist()
        if i % 3 == 0:
            words[5:5] = items[i % 25][1].split(", ")
        rows.append((i, "-".join(words)))
    rows += [(100, None), (101, ""), (102, "zz yy zz"), (102, "zz yy zz"), (None, "--")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("gram", F.lit(1)).withColumn("length", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in benchmark_filter.find_hits(docs, bench).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0)) == sorted(
        ((i, *brute_hits(t, items)) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0)
    )
    kept = benchmark_filter.decontaminate(docs, bench)
    want = [t for _, t in rows if not (brute_hits(t, items)[1] and 20 * brute_hits(t, items)[1] >= brute_hits(t, items)[0])]
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(t or "" for t in want) and kept.columns == docs.columns


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "(Keep this) Secret, answer! and the rest."), (2, "nothing")], DOCS)
    bench = spark.createDataFrame([("a", "secret ANSWER")], "item_id string, text string")
    cut = {r["doc_id"]: r["text"] for r in benchmark_filter.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {1: "(Keep this) and the rest.", 2: "nothing"}
    assert benchmark_filter.find_hits(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert benchmark_filter.find_hits(docs.limit(0), bench).count() == 0


def test_a_line_is_parsed_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e\n1\tb  c 23 e", [0])], "row_key long, text string, dropped array<int>")
    parsed = line_templates._tokens(docs.withColumn("doc_id", F.col("row_key")), 5)
    assert [r["t"] for r in parsed.orderBy("at").collect()] == [list("abcde"), ["0", "b", "c", "00", "e"]]
    assert parsed._jdf.queryExecution().executedPlan().toString().count("translate(") == 1
    left = docs.select(line_templates.without_lines("text", "dropped").alias("left"))
    assert left.first()["left"] == "1\tb  c 23 e"
    assert left._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1


def test_scores_of_words_outside_the_model_stay_few():
    scores = toxic_segments._Scores(toxic_segments.ToxicModel({"a": 1.0}, {"": -0.5, "wxyz": 2.0}, 1.0, 1.0, (0.0, 0.0, 0.0)))
    assert [scores["a"], scores["wxyz1"], scores["b"]] == [1.0, 2.0, 0.0]
    assert {scores[f"wxyz{i}"] for i in range(120_000)} == {2.0} and len(scores) <= 50_001
