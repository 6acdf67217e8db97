"""Schemas of the input tables (what a layout model emits) and of the nested exchange format."""

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SPAN = "struct<text:string,superscript:boolean,math:boolean,html:string>"
LINE = f"struct<text:string,bbox:{BBOX},removed:boolean,spans:array<{SPAN}>>"
CHILD = f"struct<block_type:string,removed:boolean,bbox:{BBOX},html:string,lines:array<{LINE}>>"

LAYOUT_PAGES = "doc_id bigint, page int, width double, height double"
LAYOUT_BLOCKS = (
    f"doc_id bigint, page int, seq int, block_type string, removed boolean, bbox {BBOX}, html string, "
    f"lines array<{LINE}>, children array<{CHILD}>"
)
DRAWINGS = f"doc_id bigint, page int, rect {BBOX}, type string, fill array<double>, color array<double>"
PAGE_TEXT = "doc_id bigint, page int, text string"
RECOGNIZED_LINES = "doc_id bigint, page int, ord int, text string"

# Nested exchange format: one JSON object per document.
SENTENCE = f"struct<text:string,boxes:array<{BBOX}>>"
FOOTNOTE = f"struct<text:string,bbox:{BBOX},marker:string,font_scale:double>"
PARAGRAPH = (
    f"struct<text:string,boxes:array<{BBOX}>,sentences:array<{SENTENCE}>,reading_index:int,continuation:boolean,"
    f"role:string,footnotes:array<{FOOTNOTE}>>"
)
IMAGE = f"struct<bbox:{BBOX},reading_index:int,role:string,caption_text:string,caption_bbox:{BBOX}>"
METADATA = f"struct<bbox:{BBOX},text:string,sentences:array<{SENTENCE}>,source_type:string>"
PAGE = (
    f"struct<page:int,width:double,height:double,blocks:array<{PARAGRAPH}>,images:array<{IMAGE}>,"
    f"metadata_blocks:array<{METADATA}>>"
)
FULL_BLOCK = (
    f"struct<role:string,text:string,page:int,bbox:{BBOX},reading_index:int,sentences:array<{SENTENCE}>,"
    f"flat_block_ref:int,continuation:boolean,caption_text:string,caption_bbox:{BBOX},"
    f"footnotes:array<{FOOTNOTE}>,layout_type:string>"
)
GLOBAL_MAP = (
    "struct<acronyms:array<struct<term:string,definition:string>>,core_methodology:string,"
    "assumed_concepts:array<string>>"
)
ANALYSIS = (
    f"doc_id bigint, filename string, page_count int, global_map {GLOBAL_MAP}, pages array<{PAGE}>, "
    f"linear_blocks array<{FULL_BLOCK}>, language string, edits string"
)

CONCEPT = "struct<term:string,explanation:string>"
EXPLANATION = f"struct<sentence_indices:array<int>,quote:string,concepts:array<{CONCEPT}>>"
EXPLAIN_RESPONSE = (
    f"struct<sentence_explanations:array<{EXPLANATION}>,"
    "paragraph_context:struct<section_role:string,narrative:string>>"
)
PROGRESS_EVENTS = (
    "job_id bigint, event_id bigint, ts timestamp, phase string, message string, tier_index int, "
    "chunk_index int, total_chunks int"
)
