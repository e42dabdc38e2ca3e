"""Schemas of the records that readers take and writers make."""

FACTS = "array<struct<entity:string,behavior:string,context:string,priority:int>>"
RECORD = (
    "popsci_title string, popsci_content string, popsci_url string, wiki_title string, wiki_content string, wiki_url string, "
    f"wiki_keyfacts {FACTS}, source string, content_relevance_score int, model_name string, model_title string, model_output string, wiki_content_matched string"
)
_ARTICLE = f"struct<title:string,content:string,url:string,keyfacts:{FACTS}>"
NESTED = f"original_data struct<original_data:struct<popsci_article:{_ARTICLE},wikipedia_article:{_ARTICLE},source:string>>, models map<string,struct<title:string,content:string,keyfacts:{FACTS}>>"
RESULT = (
    "doc_id long, title string, model_name string, source string, content_relevance_score int, simplicity_fkgl_score double, simplicity_interpretation string, "
    "coherence_ppl_score double, coherence_interpretation string, coherence_llm_score double, vividness_score double, figurativeness double, emotionality double, decorativeness double, "
    "keyfacts_precision double, keyfacts_recall double, keyfacts_precision_by_priority map<string,double>, keyfacts_recall_by_priority map<string,double>, "
    "informativeness_score double, informativeness_error string, informativeness_note string"
)
SECTIONS = "array<struct<heading:string,content:string,score:int>>"
