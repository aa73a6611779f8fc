"""The id files' encoder keeps frequent units."""

import numpy as np

from cloakstone.llm.bpe_automaton import vocabulary_path
from cloakstone.llm.id_files import LibraryEncoder


def test_frequent_units_are_kept():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    encoder = LibraryEncoder(open(vocabulary_path(), encoding="utf-8").read(), room=8)
    met, tokenize = [], encoder.tokenize
    encoder.tokenize = lambda letters: (met.append(letters), tokenize(letters))[1]
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    for i in range(60):
        text = f"a hot x{name(i)}, été{name(i)}. 12:{i} z{name(i)}\n\nhot"
        assert encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    # the words that every text has, met once; those of one text are let go
    assert met.count("Ġhot") == 1 and met.count("hot") == 1
    assert len(encoder) + len(encoder.elder) < 50
