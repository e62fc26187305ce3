import base64

import pytest

from prepwright.llm import token_counts

# Blanks before a line feed belong to it, however many they are.
PATTERN = r" ?\p{L}+|\s*[\r\n]+|\s+(?!\S)|\s+"
RANKS = [*[bytes([b]) for b in range(256)], b"\n ", b"  ", b" \n"]


@pytest.mark.parametrize("blanks", [10, 300])
def test_a_line_feed_takes_the_blanks_before_it(blanks, tmp_path):
    path = tmp_path / "ranks.tiktoken"
    path.write_text("".join(f"{base64.b64encode(b).decode()} {i}\n" for i, b in enumerate(RANKS)))
    encoder = token_counts.Encoder(str(path), PATTERN)
    for words in range(token_counts.LEAF - 3, token_counts.LEAF + 3):
        for run in ("\n" + " " * blanks, "\n" + " " * (blanks + 1)):
            text = " a" * words + run + "b c"
            at = text.index("b")
            new, tree, _ = token_counts.edited(text, token_counts.tree_of(text, encoder), at, at, "\n", encoder)
            assert tree.chars == len(new)
            assert tree.tokens == len(encoder.encoding.encode_ordinary(new))
