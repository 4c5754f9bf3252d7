from canonry.functions.text import (  # noqa: F401
    char_ngrams, js_trim, normalize_text, python_strip, split_lines, split_whitespace,
    strip_token, tokenize_terms, word_terms,
)
from canonry.functions.vectors import cosine, dot, l2_norm  # noqa: F401
from canonry.functions.arrays import replace_sentinel  # noqa: F401
