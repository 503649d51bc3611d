import random

import pytest

from tessera.markup import consolidate as co
from tessera.markup.consolidate import Scored


def test_border_is_longest():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(2))
        want = max(n for n in range(min(len(a), len(b)) + 1) if a[len(a) - n :] == b[:n])
        assert co.border(a, b) == b[:want]


def test_empty_and_single():
    assert co.consolidate([]) == []
    one = co.consolidate([Scored("a", "text", 0.5, "S")])
    assert [(c.id, c.text, c.sources) for c in one] == [("a", "text", ("a",))]


def test_end_meets_beginning():
    shared = "the shared passage of more than thirty letters"
    out = co.consolidate([Scored("1", f"First words come here and {shared}", 0.92, "S"), Scored("2", f"{shared} and then it goes on elsewhere", 0.88, "S")])
    assert len(out) == 1 and out[0].score == pytest.approx(0.9, abs=0.01)
    assert out[0].text == f"First words come here and {shared} and then it goes on elsewhere"
    assert out[0].id == "consolidated-1+2" and out[0].sources == ("1", "2")


def test_containment_and_weighted_score():
    short = "This sentence is inside of the other one."
    long = short + " And the other one has a lot more to say about it than that."
    out = co.consolidate([Scored("a", short, 1.0, "S"), Scored("b", long, 0.8, "S")])
    assert len(out) == 1 and out[0].text == long and 0.8 < out[0].score < 0.9


def test_chain_of_three_and_sections():
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "iota kappa lambda mu nu xi omicron pi rho sigma"
    chunks = [Scored("1", f"one two three {a}", 0.9, "S"), Scored("2", f"{a} between {b}", 0.8, "S"), Scored("3", f"{b} four five six", 0.7, "S"), Scored("4", "Something else entirely, in another place of the text.", 0.95, "T")]
    out = co.consolidate(chunks)
    assert [c.id for c in out][0] == "4" and len(out) == 2 and set(out[1].sources) == {"1", "2", "3"}


def test_little_overlap_stays():
    out = co.consolidate([Scored("1", "Completely different words stand here.", 0.9, "S"), Scored("2", "Nothing of it appears in that one at all.", 0.8, "S")])
    assert [c.id for c in out] == ["1", "2"]


def test_structure_before_prose():
    prose = "Prose explains at length what the code does and why anyone would want to run it."
    code = "# Title\n```python\nprint(1)\n```"
    assert co.is_structural(code) and not co.is_structural(prose)
    out = co.consolidate([Scored("p", prose, 0.9, "S"), Scored("c", code, 0.8, "S")])
    assert len(out) == 1 and out[0].text.startswith("# Title") and out[0].text.endswith("run it.")
    assert len(co.consolidate([Scored("p", prose, 0.9, "S"), Scored("c", code, 0.8, "T")])) == 2


def test_rows_and_scores_stay_in_bounds():
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(30)]
    for _ in range(60):
        chunks = [Scored(str(i), " ".join(rng.choices(vocab, k=rng.randint(3, 25))), rng.random(), rng.choice(["A", "B", None])) for i in range(rng.randint(1, 8))]
        out = co.consolidate(chunks)
        assert len(out) <= len(chunks) and sorted(s for c in out for s in c.sources) == sorted(c.id for c in chunks)
        assert all(min(c.score for c in chunks) - 1e-9 <= c.score <= max(c.score for c in chunks) + 1e-9 for c in out)
        assert [c.score for c in out] == sorted((c.score for c in out), reverse=True)
