"""op9: keys far inside a candidate."""

import numpy as np
import pytest

from agrolattice.llm import secrets


def test_windows_cover_a_candidate_and_its_context():
    text = "x " + "".join(chr(65 + i % 26) for i in range(300)) + " after it"
    seen = [secrets.surroundings(text, 2, 2 + n) for n in (12, 32, 33, 300)]
    windows, begins = secrets.windows_of(seen)
    assert begins.tolist() == [0, 1, 2, 4, 10] and {len(w) for w in windows} == {96}
    assert all(any(text[i:i + 5] in w for w in windows[4:]) for i in range(len(text) - 5))
    assert secrets.largest(np.array([1.0, 3, 3, 2, 5, 4]), np.array([0, 1, 4, 6])).tolist() == [0, 1, 4]


@pytest.mark.parametrize("after", [70, 210])
def test_key_late_in_a_run(make_docs, after):
    rng = np.random.default_rng(4)
    words = ["report", "section", "long", "name", "station", "monthly", "view", "pages"]

    def path(n):
        return "-".join(rng.choice(words, n // 4))[:n] + "/7-"

    digits = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    found = [f"see {path(after)}{digits(40)} for it" for _ in range(200)]
    plain = [f"see {path(after + 40)} for it" for _ in range(200)]
    got = {r["doc_id"]: len(r["extra"]) for r in secrets.find_secrets(make_docs(found + plain)).collect()}
    # what comes before the keys does not tell the two apart
    assert len(got) == 400 and sum(got[i] for i in range(200, 400)) <= 4
    # unseen ones of the network itself
    x = [secrets.windows_of([secrets.surroundings(t, 4, len(t) - 7) for t in found[k::2] + plain[k::2]]) for k in (0, 1)]
    y = np.repeat([1.0, 0.0], 100)
    seen, unseen = ((secrets._classes(w), b) for w, b in x)
    score = secrets.CharacterNetwork().fit(seen[0], y, seen[1]).calibrate(seen[0], y, seen[1]).score(*unseen)
    assert ((score > 0.5) == (y > 0)).mean() > 0.95


def test_scores_in_chunks():
    """A run of any length is scored a chunk of windows at a time, with the result of all at once."""
    rng = np.random.default_rng(8)
    text = " ".join("".join(rng.choice(list("abc0123_-"), int(n))) for n in (12, 700, 64, 5000, 30))
    seen = [secrets.surroundings(text, s, e) for s, e, _ in secrets.candidate_spans(text, [])]
    chunks = list(secrets.window_chunks(seen, 7))
    windows, begins = secrets.windows_of(seen)
    assert [w for c, _ in chunks for w in c] == windows and max(len(c) for c, _ in chunks) == 7
    assert [o for _, c in chunks for o in c] == np.repeat(np.arange(len(seen)), np.diff(begins)).tolist()
    net = secrets.CharacterNetwork()
    assert np.allclose(net.score_candidates(seen, 7), net.score(secrets._classes(windows), begins))
    assert len(net.score_candidates([])) == 0
