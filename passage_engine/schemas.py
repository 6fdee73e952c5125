"""Tables that the engine reads and writes; nothing is inferred."""

PAGES = "collection_id string, source_file string, page int, text string"
CHUNKS = "collection_id string, pipeline string, chunk_ord int, source_file string, page int, start int, end int, section_title string, text string"
POSTINGS = "collection_id string, pipeline string, chunk_ord int, term string, tf bigint, weight double"
TERM_STATS = "collection_id string, pipeline string, term string, df bigint, idf double"
VECTORS = "collection_id string, pipeline string, chunk_ord int, embedding array<float>, norm double"
QUESTIONS = "question_idx int, question string, truth string"
GROUND_TRUTH_IN = "question string, answer string"
GROUND_TRUTH = "question string, answer string, source_document string, page int, doc_section string, chunk_id string, generated_by string"
META = ["collection_id", "page", "start", "end", "section_title", "source_file"]
METRICS = ("answer_relevancy", "faithfulness", "context_precision", "context_recall")
