import zlib

import numpy as np

from lodestone.llm import language


def test_held_out_accuracy(spark, small):
    train = small.where(~language.held_out() & small["lang"].isNotNull())
    found = language.identify(small, *language.prototypes(train)).join(small.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    tested = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in tested) >= 0.95 * len(tested) and all(0 <= r["score"] <= 1 for r in found)


def test_trigrams_and_binding():
    decode = lambda t: ["".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in language.trigrams(t)]
    assert decode("Ab,, c1") == [" ab", "ab ", "b c", " c "] and decode("12 .") == decode(None) == []
    one = language.bundle(["abc"])[0]
    letters = [np.roll(language._vector(ord(c)).astype(float), k) for c, k in zip("abc", (2, 1, 0))]
    around = [[32, ord("a"), ord("b")], [ord("a"), ord("b"), ord("c")], [ord("b"), ord("c"), 32]]
    want = sum(np.prod([np.roll(language._vector(x).astype(float), k) for x, k in zip(g, (2, 1, 0))], axis=0) for g in around)
    assert np.allclose(one, want / np.linalg.norm(want)) and len(letters) == 3


def test_odd_rows(odd, empty):
    langs, matrix = language.prototypes(odd.where("lang IS NOT NULL"))
    rows = {r["doc_id"]: r for r in language.identify(odd, langs, matrix).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (0, 1, 2)) and rows[5]["lang_pred"] in langs
    nothing = language.prototypes(empty)
    assert nothing[0] == [] and {r["lang_pred"] for r in language.identify(odd, *nothing).collect()} == {"und"}
    assert language.identify(empty, langs, matrix).count() == 0


def test_reruns_agree(small):
    train = small.where("lang IS NOT NULL")
    assert (language.prototypes(train)[1] == language.prototypes(train.repartition(3))[1]).all()
