"""Token files and packing against the tokenizers library on whole texts."""

import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from common import SCHEMA, frame, write_tables
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridfield.llm import containers, encoding, packing
from gridfield.llm.queries import QUERIES, tokenizer_path

ALPHABET = "abcXYZ019 \t\n.,;:!?'-_*$<|>éÉßŸÿĀıİŁŉǅǆªºµ×÷ñǿ̇ͅ가가中Σςσ 　\u0085\x1cǰẞﬁ𝒳🙂‍"


def test_any_text_has_the_librarys_ids():
    rng, own, library = random.Random(4), encoding.WordEncoder(tokenizer_path(), 5000), Tokenizer.from_file(tokenizer_path())
    assert own.by_word
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(60_000)]
    texts += ["İ,", "aİ.", "don'té", "it''s", "x<|endoftext|>y", "<|startoftext|>", "<| endoftext|>", "'S 'Ll a'RE", "ÉCOLE!?", "ŉ.", "ﬁn"]
    letters = [chr(k) for k in range(1, 0x250)]
    texts += [a + "".join(rng.choices(letters, k=2)) + rng.choice(".,;:!?") for a in letters for _ in range(20)]
    want = library.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want, strict=True) if own.encode(t.encode()) != np.array(w.ids, "<u4").tobytes()]
    assert wrong == []


def test_another_file_goes_to_the_library():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = encoding.WordEncoder(path), Tokenizer.from_file(path)
    assert not own.by_word
    for t in ("Two  blanks, İ.", "", " x\n"):
        assert own.encode(t.encode()) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def odd_rows():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 120)))) for i in range(60)]
    return rows + [(None, None), (None, "no id"), (None, "no id"), (7, "again"), (7, "again"), (70, ""), (71, " \n"), (2**63 - 1, "last"), (-3, "first"), (80, "long " * 30_000), (81, "İ, Aİ.")]


def ids_of(rows, end):
    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for _, x in rows]


def check_digests(out, rows):
    """Groups of one doc_id may stand in any order."""
    own = sorted(((i is None, i or 0, i, len(a), zlib.crc32(a.tobytes())) for (i, _), a in zip(rows, ids_of(rows, 1), strict=True)))
    out = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [x[2] for x in own]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in out) == sorted((a, b, n, c) for a, b, _, n, c in own)
    assert [r["start"] for r in out] == np.cumsum([0, *(r["n_tokens"] for r in out)])[:-1].tolist()


@pytest.mark.parametrize("parts", [1, 5])
def test_files(spark, tmp_path, parts):
    rows = odd_rows()
    docs = frame(spark, rows).repartition(parts).withColumns({"id": F.lit(1), "place": F.lit(2), "none": F.lit(True), "frame": F.lit("x")})
    folder = str(tmp_path / "set")
    check_digests(containers.write(docs, tokenizer_path(), 1, folder, container_bytes=3000).digests().collect(), rows)
    files, ids = containers.TokenFiles.open(spark, folder), ids_of(rows, 1)
    assert files.table.count() > 5
    for i in (3, 7, 80, -3, 2**63 - 1):
        assert sorted(files.document(i)) == sorted(a.tolist() for (k, _), a in zip(rows, ids, strict=True) if k == i)
    assert files.document(10**6) == []
    blob = bytes(files.table.where("first_id is not null").orderBy("part", "turn").first()["blob"])
    index, read, none = containers.open_container(blob, files.dictionary)
    assert not none and read(0).tolist() == ids[[k for k, _ in rows].index(int(index["id"][0]))].tolist()
    with pytest.raises(ValueError):
        containers.open_container(blob, b"another dictionary")
    # another process, without Spark, reads a document from the folder alone
    script = """
import sys, pyarrow.parquet as pq
from gridfield.llm.containers import open_container
folder = sys.argv[1]
dictionary = pq.read_table(folder + "/dictionary").column("dictionary")[0].as_py()
for row in pq.read_table(folder + "/containers").to_pylist():
    index, read, none = open_container(row["blob"], dictionary)
    for k, entry in enumerate(index):
        if entry["id"] == 3 and not none:
            print(read(k).tolist())
"""
    said = subprocess.run([sys.executable, "-c", script, folder], capture_output=True, text=True, check=True, cwd="/root/repo").stdout
    assert said.strip() == str(ids[3].tolist())


def test_small_sets_have_a_dictionary_too(spark, tmp_path):
    rows = [(1, "a few words"), (2, "a few words more")]
    files = containers.write(frame(spark, rows), tokenizer_path(), 1, str(tmp_path / "few"))
    assert files.dictionary
    check_digests(files.digests().collect(), rows)
    rows = [(None, "a few words"), (None, None)]
    files = containers.write(frame(spark, rows), tokenizer_path(), 1, str(tmp_path / "none"))
    check_digests(files.digests().collect(), rows)
    empty = containers.write(frame(spark, []), tokenizer_path(), 1, str(tmp_path / "empty"))
    assert empty.digests().count() == 0 and empty.document(1) == []


def check_pieces(out, rows):
    """Whole, gapless, in place; rows of equal ids and texts are told apart by nothing and so are counted."""
    ids = ids_of(rows, 2)
    by_crc = {}
    for r in out:
        by_crc.setdefault((r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]), []).append(r)
    want = {}
    for (i, _), a in zip(rows, ids, strict=True):
        at = 0
        for n in packing.cuts(len(a), 4096, 64):
            key = (i, len(a), at, n, zlib.crc32(a[at : at + n].tobytes()))
            want[key] = want.get(key, 0) + 1
            at += n
        assert at == len(a)
    assert {k: len(v) for k, v in by_crc.items()} == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096


@pytest.mark.parametrize("parts", [1, 5])
def test_pieces(spark, parts):
    rows = odd_rows()
    docs = frame(spark, rows).repartition(parts).withColumns({"length": F.lit("x"), "part": F.lit(9), "number": F.lit(1)})
    check_pieces(packing.pack(docs, tokenizer_path(), 2).collect(), rows)


def test_queries(spark, tmp_path):
    rows = odd_rows()
    write_tables(spark, tmp_path, documents=spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA))
    check_digests(QUERIES["op5_token_ids"](spark, str(tmp_path)).collect(), rows)
    check_pieces(QUERIES["op9_harmonic_packing"](spark, str(tmp_path)).collect(), rows)
