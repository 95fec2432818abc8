from homolith.llm import secrets

HEX = "0123456789abcdef01234567"
KEY = "x9Qz7LmPw2VbN4tRk8Ys3Ud"


def found(text, models):
    base = sorted(secrets.base_spans(text))
    return [text[a:b] for a, _, b in secrets.model_spans(text, base, models)]


def test_pieces_beside_base_spans_are_judged():
    models = secrets.Markov(secrets.random_strings()), secrets.Markov(secrets.ordinary(["ordinary", "words", "stand", "here", "and", "there"]) + secrets.numbers())
    assert found(f"key {KEY} end", models) == [KEY]
    # A key on either side of a base span, or of two, is found without it; the base span itself isn't found again.
    assert [x.strip("-_/+=") for x in found(f"key {KEY}-{HEX} end", models)] == [KEY]
    assert [x.strip("-_/+=") for x in found(f"key {HEX}-{KEY} end", models)] == [KEY]
    assert [x.strip("-_/+=") for x in found(f"{HEX}-{KEY}-{HEX}", models)] == [KEY]
    # What is left and too short is not judged, nor is a base span alone.
    assert found(f"{HEX}-x9Qz7Lm", models) == [] and found(HEX, models) == [] and found("", models) == []
    assert found("ordinary-words-stand-here-and-there", models) == []
