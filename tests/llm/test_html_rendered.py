"""HTML extraction: formulas and drawings in a text belong to it."""

import pytest

from trialgrid.llm import html as X


@pytest.mark.parametrize("page,want", [
    ("<p>let <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> be</p>", ["let x=2 be"]),
    ("<p>a<math><semantics><mi>y</mi><annotation>\\y</annotation></semantics></math>b</p>", ["ayb"]),
    ("<p>see <svg><title>no</title><desc>no</desc><path d='M0'/><g><text>label</text></g></svg> here</p>", ["see label here"]),
    ("<p>x <object data='f'><param name='n'>shown instead</object> y</p>", ["x shown instead y"]),
    ("<p>1<canvas>no</canvas>2</p>", ["12"])])
def test_rendered_text_stays(page, want):
    assert [b.text for b in X.blocks(page)] == want
