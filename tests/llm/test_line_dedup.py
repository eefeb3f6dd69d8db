import hashlib
from collections import Counter

import pytest

from inkgraph.llm.line_dedup import line_dedup


def plain(rows):
    """Line dedup by its docstring: places are (id, text), ids ascending, null last, then SHA-256."""

    def cut_up(text):
        out, start, before = [], 0, None
        lines = text.split("\n")
        for i, line in enumerate(lines):
            h = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
            cut = before is not None and (h == before or ((before * 1000003 + h) >> 6) % 3 == 0)
            if cut and i - start >= 1 or i == len(lines) - 1:
                out.append((start, lines[start : i + 1]))
                start = i + 1
            before = h
        return out

    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest())
    seen, out = set(), {}
    for r in sorted({r for r in rows if r[1] is not None}, key=key):
        kept, n, last = [], 0, None
        for _, chunk in cut_up(r[1]):
            tail = len(chunk) < 2  # what is left at the end goes by the chunk before it too
            name = (tail, *(last if tail and last else []), *chunk) if last or not tail else None
            if name and name in seen:
                n += len(chunk)
            else:
                kept += chunk
            seen.add(name)
            last = chunk
        out[r] = (len(r[1].split("\n")), n, "\n".join(kept))
    return Counter((r[0], *out.get(r, (0, 0, ""))) for r in rows)


@pytest.mark.parametrize("n", [0, 1])
def test_texts_that_share_an_id_keep_their_own_lines(spark, n):
    part = lambda a, b: "\n".join(f"line {i}" for i in range(a, b))
    own = lambda k, m: "\n".join(f"own {k} {i}" for i in range(m))
    rows = [
        (None, f"{part(0, 12)}\n{own(1, 9)}"), (None, f"{own(2, 5)}\n{part(0, 12)}\n{own(3, 4)}"), (None, own(4, 20)), (None, f"{own(5, 3)}\n{part(3, 12)}"),
        (7, f"{part(0, 12)}\n{own(6, 6)}"), (7, f"{own(7, 2)}\n{part(0, 12)}"), (7, own(8, 12)), (8, part(0, 12)), (8, part(0, 12)), (None, None), (9, ""),
        (10, "same\n" * 31), (11, f"{own(9, 3)}\n" + "same\n" * 18 + own(10, 2)), (12, "\n\n\n"), (13, "a\n" * 5), (14, f"{part(0, 3)}\n{part(0, 3)}\n{part(0, 400)}"),
    ][n:]
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(r[2] <= r[1] for r in got) and sum(r[2] for r in got) > 0
    assert got == plain(rows)


def test_runs_of_one_line_shrink(spark):
    rows = [(1, "x\n" + "same\n" * 40 + "y"), (2, "z\n" + "same\n" * 41 + "y")]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed >= 34 and got[2].n_removed >= 36 and got[1].kept_text.startswith("x\nsame") and got[2].kept_text.startswith("z\n")


def test_whole_copies_go_whole(spark):
    rows = [(n * 10 + k, "\n".join(f"{n} line {i}" for i in range(n))) for n in range(2, 30) for k in (1, 2)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[n * 10 + 1].n_removed == 0 and got[n * 10 + 2].n_removed == n for n in range(2, 30))


def test_long_runs_in_other_surroundings_go_but_for_their_ends(spark):
    own = lambda k, n: [f"own {k} {i}" for i in range(n)]
    rows, total = [], 0
    for k in range(40):
        run = [f"run {k} {i}" for i in range(64)]
        rows += [(2 * k, "\n".join(own(4 * k, 5) + run + own(4 * k + 1, 7))), (2 * k + 1, "\n".join(own(4 * k + 2, 3 + k % 9) + run + own(4 * k + 3, 4)))]
        total += len(run)
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in got) >= 0.88 * total and all(r.n_removed == 0 for r in got if r.doc_id % 2 == 0)
