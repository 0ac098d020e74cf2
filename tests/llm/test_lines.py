import pytest
import xxhash

from lodestone.llm import lines


def brute(rows, least=lines.MIN_WORDS, near_from=lines.NEAR_WORDS):
    """(exact, near, text left) of each document, comparing every line with every earlier one."""
    code = lambda words: b"".join(xxhash.xxh3_64_digest(w) for w in words)
    before, out = [], {}
    for doc, text in sorted(rows):
        exact, near, left = 0, 0, []
        for line in (text or "").split("\n"):
            words = line.encode().split()
            if len(words) < least:
                left.append(line)
                continue
            if words in before:
                exact += 1
            elif len(words) >= near_from and any(len(b) >= near_from and lines.within_one(code(words), code(b)) for b in before):
                near += 1
            else:
                left.append(line)
            before.append(words)
        out[doc] = (exact, near, None if text is None else "\n".join(left))
    return out


def result(df):
    return {r["doc_id"]: (r["n_exact"], r["n_near"], r["text"]) for r in lines.dedup(df).collect()}


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


@pytest.mark.parametrize("x, y", [("abcd", "abcd"), ("abcd", "abxd"), ("abcd", "abcde"), ("abcd", "bcd"), ("abcd", "acbd"), ("", "a"), ("aab", "ab"), ("abcd", "abxyd"), ("abc", "abcde")])
def test_within_one(x, y):
    code = lambda s: b"".join(xxhash.xxh3_64_digest(c) for c in s)
    assert lines.within_one(code(x), code(y)) == lines.within_one(code(y), code(x)) == (distance(x, y) <= 1)


def test_documents(small):
    assert result(small) == brute([(r["doc_id"], r["text"]) for r in small.collect()])


def test_edits_of_every_kind(spark):
    base = [f"w{i}" for i in range(12)]
    made = [base, base[:3] + base[4:], base[:11], base + ["end"], ["start", *base], base[:6] + ["new"] + base[6:], [*base[:5], "x", *base[6:]], ["x", *base[1:]], [*base[:11], "x"], base[::-1], base[:9], base[:10]]
    made += [base[:5] + ["y"] * 3 + base[8:], [*base[:4], "q", *base[5:8], "q", *base[9:]], base[:4], base[:4]]
    rows = [(i, " ".join(m) + "\nshort line\n" + " ".join(m)) for i, m in enumerate(made)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_short_lines_go_as_exact_copies(spark):
    rows = [(1, "All rights reserved.\n\none\n \none two three four"), (2, "All rights  reserved.\n\none\n \none two three five"), (3, "one two three four\nAll rights reserved")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == {1: (0, 0, rows[0][1]), 2: (2, 0, "\n \none two three five"), 3: (1, 0, "All rights reserved")}


def test_odd_rows(odd, empty):
    known = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert result(known) == brute([(r["doc_id"], r["text"]) for r in known.collect()])
    out = lines.dedup(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_exact", "n_near"] and out.count() == odd.count()
    assert lines.dedup(empty).count() == 0
    assert out.where("doc_id = 5").select("n_exact").distinct().count() == 1
