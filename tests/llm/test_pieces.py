import public_tokenizers as P
import regex
from hypothesis import example, given, settings
from hypothesis import strategies as st

from sensorloom.llm.pieces import split_pieces

PATTERN = regex.compile(P.PATTERN, regex.V0)
some = st.text(st.sampled_from(list("'sstmdrevl Ll19.,\n\t 　é漢😀_\x1c")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(some, max_size=6))
@example(["it's we'll 're ''s", " 's", "'", "  ", "", "a  b\n\nc ", "x'rest'LL"])
def test_same_as_the_pattern(texts):
    want = [[m.encode() for m in PATTERN.findall(t)] for t in texts]
    pieces, bounds = split_pieces(texts)
    assert [pieces[a:b] for a, b in zip(bounds[:-1], bounds[1:])] == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=60).filter(lambda t: not regex.search(r"[\x1c-\x1f]", t)))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert split_pieces([text])[0] == [m.encode() for m in PATTERN.findall(text)]
