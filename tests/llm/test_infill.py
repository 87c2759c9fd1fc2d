import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st

from tarmac.llm import infill

TEXTS = [None, "", "a", "Hello, world", "x" * 5000, "é😀\r\n\x00b", "has <P> mark", "<S", "ends in <S", "<M", "1 2 3\n\n4", "ab1cd2" * 300]


def brute(i, text):
    """The row by the rule's own words."""
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n, digest = len(units), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@given(st.integers(-(1 << 63), (1 << 63) - 1), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab<PSM>1 ", max_size=60))
def test_texts_come_back(i, text):
    n, form, _, _, output = made = infill.transform(str(i), text)
    assert made == brute(i, text) and infill.rebuild(output, form) == text and n == len(infill.ends_of(text)) - 1


def test_frame(spark):
    rows = [(i, t) for i in (None, 0, 1, 2, 3, 7, 50) for t in TEXTS] * 2
    got = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    want = sorted(((i, *brute(i, t), hashlib.sha256(brute(i, t)[4].encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = got.select(infill.restored(got.output, got.form).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(t or "" for _, t in rows)


def test_edges(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    big = "word 12 ü" * 400_000
    clash = spark.createDataFrame([(5, big, 1, "y")], "doc_id long, text string, n int, Form string")
    row = infill.fill_in_middle(clash).first()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == brute(5, big)
