"""Schemas of the relations the package reads and writes."""

from __future__ import annotations


class SchemaInferenceError(ValueError):
    """An input relation lacks a needed column or has ambiguous ones."""


CHOICE_SHUFFLE = (
    "struct<enabled:boolean,seed:bigint,`order`:array<int>,original_answer_index:int,original_choices:array<string>>"
)
QA_META = (
    "struct<source:string,split:string,article_id:string,article_title:string,paragraph_number:string,"
    f"difficulty_level:string,raw_qa:string,raw:string,choice_shuffle:{CHOICE_SHUFFLE}>"
)
QA_DDL = (
    "example_id string, paragraph_id string, paragraph_text string, question string, "
    f"choices array<string>, answer_index int, metadata {QA_META}"
)
# TRIAL_INDEX_2 is the report's TRIAL_INDEX: Spark compares names without case, and trial_index is there too
GAZE_META_COLUMNS = (
    "article_batch", "article_id", "article_title", "paragraph_id", "difficulty_level", "onestopqa_question_id",
    "question_preview", "repeated_reading_trial", "practice_trial", "trial_index", "TRIAL_INDEX_2", "paragraph",
    "question", "selected_answer", "is_correct",
)
GAZE_RECORD = (
    "struct<reader_id:string,paragraph_id:string,word_index:int,word:string,trt:double,"
    "fixation_count:double,skip:double,metadata:map<string,string>>"
)
QA_STRUCT = (
    "struct<example_id:string,paragraph_id:string,paragraph_text:string,question:string,"
    f"choices:array<string>,answer_index:int,metadata:{QA_META}>"
)
ALIGNED_DDL = f"qa {QA_STRUCT}, reader_gaze map<string,array<{GAZE_RECORD}>>"
EVIDENCE = (
    "struct<chunk_id:string,text:string,score:double,char_start:int,char_end:int,text_score:double,"
    "gaze_score:double,alpha:double,text_candidate_rank:int,candidate_top_n:int,selected_reader_id:string>"
)
RETRIEVAL_DDL = (
    "example_id string, reader_id string, condition string, ranked_chunks array<string>, "
    f"metadata struct<evidence:array<{EVIDENCE}>,paragraph_id:string,alpha:double,candidate_top_n:int,"
    "selected_reader_id:string,score_formula:string>"
)
PREDICTION_DDL = (
    "example_id string, reader_id string, condition string, prompt string, raw_output string, "
    "predicted_index int, gold_index int, "
    f"metadata struct<scoring_mode:string,choice_shuffle:{CHOICE_SHUFFLE}>"
)
EMBEDDING_COLUMNS = (
    "embedding_id", "example_id", "reader_id", "condition", "chunk_id", "paragraph_id", "text", "char_start",
    "char_end", "token_indices", "vec",
)
QUERY_COLUMNS = ("example_id", "paragraph_id", "question", "choices", "answer_index", "qvec")
EMBEDDING_DDL = (
    "embedding_id string, example_id string, reader_id string, condition string, chunk_id string, "
    "paragraph_id string, text string, char_start int, char_end int, token_indices array<int>, vec array<float>"
)
QUERY_DDL = (
    "example_id string, paragraph_id string, question string, choices array<string>, answer_index int, "
    "qvec array<float>"
)
ARTICLE_DDL = "article_id string, title string, paragraphs array<map<string,string>>"
ARTICLE = "struct<article_id:string,title:string,paragraphs:array<map<string,string>>>"

BY_CONDITION_COLUMNS = ("condition", "reader_id", "accuracy", "count", "scored_count", "missing_parse_rate")
PAIRED_COLUMNS = ("baseline", "treatment", "n", "mean_delta", "standard_error", "ci95_low", "ci95_high")
