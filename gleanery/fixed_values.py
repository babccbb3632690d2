"""Constants, templates and defaults that results depend on.

Everything here is data. Changing a value changes results, so the values are
kept together, in plain text and in their natural order.
"""

# Chunking: window size and overlap in characters, separators in order of preference.
CHUNK_SIZE = 250
CHUNK_OVERLAP = 100
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
CHUNK_ID_INFIX = "_chunk_"

# Evaluation: cut-offs, shortest usable chunk (exclusive), sample seed, length of the report of recent results.
K_VALUES = [5, 10]
MIN_QUESTION_CHUNK_CHARS = 200
SAMPLE_SEED = 42
RECENT_RESULTS = 10
CRITERIA = ["faithfulness", "relevance", "conciseness"]

# Retrieval and chat.
ANSWER_TOP_K = 5
PROMPT_HISTORY_TURNS = 5

# Rotation of search terms.
BACKFILL_START = "2020-01-01"
SEARCH_WINDOW_FLOOR = "1900-01-01"

# Missing-value texts of parsed article records.
UNKNOWN_YEAR = "Unknown"

# Prompt templates; {name} marks a column.
SHORT_QUESTION_PROMPT = "Generate one specific question that this text answers: {excerpt}"

QUESTION_PROMPT = """Read this excerpt from a research paper and write ONE specific factual question that this excerpt directly answers. The question should be answerable using ONLY the information in this excerpt.

    Excerpt:
    {chunk}

    Respond with ONLY the question, nothing else."""

ANSWER_PROMPT = """Answer the question based on the context below.

Context:
{context}

Question: {question}
Answer:"""

JUDGE_PROMPT = """Rate this answer on a scale of 1-5 for each criterion. Respond with ONLY a JSON object, no other text.

Question: {question}
Context: {context}
Answer: {answer}

Criteria:
- faithfulness (1-5): Is the answer grounded in the context, with no hallucinated facts?
- relevance (1-5): Does it directly answer the question asked?
- conciseness (1-5): Is it appropriately brief without unnecessary repetition?

JSON format: {"faithfulness": X, "relevance": X, "conciseness": X}"""
