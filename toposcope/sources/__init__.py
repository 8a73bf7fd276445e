from toposcope.sources.lexicon import read_lexicon, read_tag_map
from toposcope.sources.results import (
    read_document_frequencies,
    read_measures,
    read_singular_values,
    read_topic_map,
    read_topic_words,
)
from toposcope.sources.text import read_documents, read_lines
from toposcope.sources.words import default_stop_words, read_known_words, read_word_list, read_word_vectors, stop_words

__all__ = [
    "default_stop_words",
    "read_document_frequencies",
    "read_documents",
    "read_known_words",
    "read_lexicon",
    "read_lines",
    "read_measures",
    "read_singular_values",
    "read_tag_map",
    "read_topic_map",
    "read_topic_words",
    "read_word_list",
    "read_word_vectors",
    "stop_words",
]
