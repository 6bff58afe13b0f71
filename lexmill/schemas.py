"""Schemas of files and tables."""

DUMP = "id string, url string, title string, text array<array<string>>"
QA_ENTRY = "_id string, id string, question string, answer string, supporting_facts array<array<string>>"

ARTICLE = "article_id long, page_id long, title string, plain_text_paragraphs array<string>, paragraph_token_counts array<int>, is_disambiguation boolean"
VOCABULARY = "term_id long, term string, document_frequency long, idf_value double"
INTERNAL_LINK = "link_id long, from_article long, from_page_id long, to_article long, to_title string, anchor_text string"
INVERTED_INDEX = "term string, article long, tf_idf_score double"
PAGERANK = "article long, score double"

TABLES = {"article": ARTICLE, "vocabulary": VOCABULARY, "internal_link": INTERNAL_LINK, "inverted_index": INVERTED_INDEX, "pagerank": PAGERANK}
