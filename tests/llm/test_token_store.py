import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routegraph.llm import token_store as s
from routegraph.llm.common import shared_folder

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


CASES = [
    "", "a", "\n", "a\nb", " a", "a ", "a  b", "a\n\nb", "x \ny", "x\n y", "\n\na", "it's don't 's", "<|endoftext|> hi", "a\tb", "ünï ça", "  ", "a\n", "日本 語", "a1b2 33", "!!! ??? ...", "é  x", "\r\n", " x",
    "The end.\nNext, word; done: yes? no!", "a.b, c,d e.", "Ωmega, ﬁn. ½.", "x" * 3000,
]


@pytest.mark.parametrize("text", CASES)
def test_encoder_equals_the_library(tokenizer, text):
    encoder = s.Encoder(PATH)
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Zé1.,'|\n\t#", max_size=30), min_size=1, max_size=4))
def test_encoder_on_random_texts(tokenizer, texts):
    encoder = s.Encoder(PATH)
    for got, text in zip(encoder.encode(texts), texts, strict=True):
        assert np.frombuffer(got, encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_letter_is_a_letter_to_the_library(tokenizer):
    """Words of one letter, or of a letter and a mark, over all of Unicode: the short cut and the library agree."""
    encoder = s.Encoder(PATH)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]
    for i in range(0, len(letters), 4000):
        text = " ".join(["x", *(x + m for x in letters[i : i + 4000] for m in ("", "!", "a&&"))])
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return s.Encoder(PATH)


def test_a_word_is_encoded_once_whatever_mark_follows(tokenizer):
    encoder, calls = s.Encoder(PATH), []
    learn = encoder.known.learn
    encoder.known.learn = lambda piece: calls.append(piece) or learn(piece)
    words = [f"word{'abcdefgh'[i]}{'stuvwxyz'[i]}é"[: 6 + i % 2] for i in range(8)]
    text = " ".join(w + m for m in ("", *",.;:!?)") for w in words)
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(calls) == len(set(calls)) <= len(words) + 9


def test_no_text_is_encoded_whole_for_its_white_space(tokenizer, prose, monkeypatch):
    encoder, lengths, whole = s.Encoder(PATH), [], s.Encoder._whole
    monkeypatch.setattr(s.Encoder, "_whole", lambda self, text: lengths.append(len(text)) or whole(self, text))
    text = "  \t" + prose(300, 5) + "\n\n" + prose(300, 6) + " \r\n" + prose(300, 7) + "\u3000 "
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert max(lengths, default=0) < 100


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab  Zé1½.,''_-|\n\t\r\x1f\x85\u3000\u2028\u0301—’ß日🙂𝒳𐄀", max_size=30), min_size=1, max_size=4))
def test_cuts_beyond_ascii(tokenizer, encoder, texts):
    for got, text in zip(encoder.encode(texts), texts, strict=True):
        assert np.frombuffer(got, encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_ids_of_slices_nulls_and_special_tokens(tokenizer, kind):
    texts = ["not read", None, "", "a, b", "x<|endoftext|> y, z", "<|endof", "text|> é", None, "word " * 50, "", "not read"]
    ids, ends = s.Encoder(PATH).encode_all(pa.array(texts, kind).slice(1, len(texts) - 2), np.array([7], "<u2").tobytes())
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts[1:-1]]
    assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_another_pre_tokenizer_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)
    other.save(str(tmp_path / "other.json"))
    texts = ["of the, and. of", "it's  a", "\nthe of"]
    for got, text in zip(s.Encoder(str(tmp_path / "other.json")).encode(texts), texts, strict=True):
        assert np.frombuffer(got, "<u2").tolist() == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("at_once", [1, 3000, 40_000, 10_000_000])
def test_parts_hold_all_rows_and_are_bounded(at_once, monkeypatch):
    monkeypatch.setattr(s, "AT_ONCE", at_once)
    row = lambda i: (i, None if i % 7 == 0 else "x" * (i * 37 % 900))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*map(row, range(a, b))) if a < b else ((), ()), (pa.int64(), pa.string()))], ["doc_id", "text"]) for a, b in ((0, 0), (0, 90), (90, 91), (91, 400), (400, 400))]
    parts = list(s._parts(iter(batches)))
    assert pa.Table.from_batches(parts).to_pylist() == [{"doc_id": i, "text": row(i)[1]} for i in range(400)]
    assert all(0 < p.num_rows <= at_once // s.ROW_BYTES + 1 for p in parts) and list(s._parts(iter([]))) == []


def test_forgetting_words_changes_nothing(tokenizer, prose, monkeypatch):
    monkeypatch.setattr(s, "MET_ONCE", 3)
    monkeypatch.setattr(s, "MET_AGAIN", 2)
    encoder, text = s.Encoder(PATH), prose(400, 1)
    for _ in range(2):
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=60), st.binary(max_size=600)), max_size=4))
def test_crc_of_joined_pieces(pairs):
    got = s.crc32_after([zlib.crc32(a) for a, _ in pairs], [zlib.crc32(b) for _, b in pairs], [len(b) for _, b in pairs])
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_chunks_are_found_again_wherever_they_stand():
    ids = np.random.default_rng(2).integers(0, 50_000, 9000).astype("<u2")
    cut = lambda x: (lambda ends: [x[a:b].tobytes() for a, b in zip([0, *ends], ends)])(s.chunk_ends(len(x), s.boundaries(x).tolist()))
    shifted = np.concatenate([np.arange(333, dtype="<u2"), ids])
    assert len(set(cut(ids)) & set(cut(shifted))) >= len(cut(ids)) - 3
    assert all(len(c) <= 2 * s.MAX_IDS for c in cut(ids)) and b"".join(cut(shifted)) == shifted.tobytes()


@pytest.fixture
def docs(frame, prose):
    long_ = prose(6000, 3)
    rows = [(i, prose(i * 3, i), "en", "s") for i in range(40)] + [(100, long_, "en", "s"), (101, long_, "en", "s"), (102, "odd  spaces\t" + long_, "en", "s")]
    return [*rows, (103, None, None, None), (104, "", "en", "s"), (3, rows[3][1], "en", "s"), (None, "no id", "en", "s")]


def test_round_trip(spark, frame, docs, tokenizer):
    rows = s.stored(frame(docs).selectExpr("*", "1 as start", "2 as kind", "3 as address"), PATH).collect()
    assert len(rows) == len(docs)
    at = 0
    want = []
    for k, text, *_ in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


@pytest.fixture
def store(spark, frame, docs):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    s.write_store(frame(docs), path, PATH)
    return path


def test_chunks_are_stored_once_and_ids_come_back(spark, docs, store, tokenizer):
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()
    got = s.read_ids(spark, store, spark.createDataFrame([(101,)], "doc_id long")).orderBy("seq").collect()
    ids = np.frombuffer(b"".join(r["payload"] for r in got), "<u2").tolist()
    assert ids == [*tokenizer.encode(docs[41][1], add_special_tokens=False).ids, 0]


def test_many_places_are_joined_by_a_shuffle(spark, frame, docs, monkeypatch):
    monkeypatch.setattr(s, "BROADCAST_PLACES", 0)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    s.write_store(frame(docs).repartition(6), path, PATH)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count() and s.read_store(spark, path).count() == len(docs)


DAMAGE = {
    "swapped ids": ("recipes", "CASE doc_id WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE doc_id END AS doc_id", "manifest"),
    "a start": ("recipes", "CASE doc_id WHEN 7 THEN 99999 ELSE start END AS start", "does not start"),
    "order": ("recipes", "CASE number WHEN 5 THEN 6 WHEN 6 THEN 5 ELSE number END AS number", "does not start|manifest"),
    "a length": ("recipes", "CASE doc_id WHEN 9 THEN n_tokens + 1 ELSE n_tokens END AS n_tokens", "does not start|manifest"),
    "a chunk list": ("recipes", "CASE doc_id WHEN 100 THEN reverse(addresses) ELSE addresses END AS addresses", "hash"),
    "a payload": ("chunks", "CASE WHEN n_ids > 60 THEN CAST(concat(payload, X'00') AS BINARY) ELSE payload END AS payload", "address"),
    "the manifest": ("manifest", "concat('0', substring(hash, 2)) AS hash", "manifest"),
}


@pytest.mark.parametrize("case", DAMAGE)
def test_damage_is_refused(spark, store, case):
    table, change, says = DAMAGE[case]
    bad = f"{store}-{uuid.uuid4().hex}"
    for name in ("chunks", "recipes", "manifest"):
        rows = spark.read.parquet(f"{store}/{name}")
        if name == table:
            rows = rows.selectExpr(*[c for c in rows.columns if c != change.rsplit(" ", 1)[-1]], change)
        rows.write.parquet(f"{bad}/{name}")
    with pytest.raises(Exception, match=says):
        s.read_store(spark, bad).collect()


@pytest.mark.parametrize("table", ["chunks", "recipes"])
def test_lost_rows_are_refused(spark, store, table):
    bad = f"{store}-{uuid.uuid4().hex}"
    for name in ("chunks", "recipes", "manifest"):
        rows = spark.read.parquet(f"{store}/{name}")
        lost = "number = 20" if name == "recipes" else f"address = X'{rows.first()['address'].hex()}'" if name == "chunks" else "false"
        (rows.where(f"not ({lost})") if name == table else rows).write.parquet(f"{bad}/{name}")
    with pytest.raises(Exception, match="lacks a chunk|NULL|null|does not start|manifest"):
        s.read_store(spark, bad).collect()


def test_small_fans_give_more_levels(spark, store, docs, monkeypatch):
    monkeypatch.setattr(s, "FAN", 4)
    nodes = s.tree(spark.read.parquet(f"{store}/recipes")).collect()
    assert sorted({r["level"] for r in nodes}) == [1, 2, 3] and all(r["gapless"] for r in nodes)
    assert [r["documents"] for r in nodes if r["level"] == 3] == [len(docs)]


def test_empty(spark, frame):
    assert s.stored(frame([]), PATH).count() == 0
