"""Both passes of the packing get small Arrow batches, and the ids go once they are cut."""

import os

import pyarrow as pa

from pathloom.llm import packing


def test_the_cut_gets_small_batches(spark, monkeypatch, tmp_path):
    rows, cut = str(tmp_path / "rows"), packing._cut
    os.mkdir(rows)

    def watched(window):
        def run(batches):
            def seen():
                for b in batches:
                    with open(f"{rows}/{os.getpid()}", "a") as f:
                        f.write(f"{b.num_rows}\n")
                    yield b

            yield from cut(window)(seen())

        return run

    made, kept = [], packing.stored
    monkeypatch.setattr(packing, "_cut", watched)
    monkeypatch.setattr(packing, "BATCH_ROWS", 50)
    monkeypatch.setattr(packing, "stored", lambda df, name, *rest: made.append(kept(df, name, *rest)) or made[-1])
    docs = spark.createDataFrame([(i, f"word {i} " * (i % 40)) for i in range(400)], "doc_id long, text string").coalesce(1)
    got = packing.packed(docs).toArrow().sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
    sizes = [int(n) for f in os.listdir(rows) for n in open(f"{rows}/{f}")]
    assert sum(sizes) == 400 and max(sizes) <= 50
    ends = [s * packing.WINDOW + o for s, o in zip(got["sequence_id"].to_pylist(), got["offset"].to_pylist(), strict=True)]
    assert ends == pa.array([0] + got["length"].to_pylist()[:-1]).to_numpy().cumsum().tolist() and len(set(got["doc_id"].to_pylist())) == 400
    assert not os.path.exists(made[0]._stored_path.removeprefix("file://"))


def test_slices_of_texts_leave_small_tables_in_a_worker():
    """The table of powers stays in a worker between stages; it is as long as the longest slice."""
    from pathloom.llm import ngram_join, quality, shingles

    for most in (ngram_join.SLICE_BYTES, quality.SLICE_BYTES):
        shingles.word_hashes(*shingles.text_bytes(pa.array(["a " * (most // 2)])))
        assert sum(x.nbytes for x in shingles._powers(1 << max(16, most.bit_length()))) <= 4 << 20
