"""Features of texts do not change their meaning with the length of the text."""

from pulseframe.llm import toxicity


def test_capitals_are_counted_alike_at_every_length():
    """Four of the ten characters of each sentence are capitals, below and above 65,536 characters."""
    describe = toxicity.Describer(toxicity.Lexicon({"idiot": 5.0}))
    shares = [describe(("ABcd " + "EFgh ") * n)[15] for n in (100, 6553, 6554, 20_000)]
    assert shares == [0.4] * 4
