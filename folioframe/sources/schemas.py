"""Declared schemas of the stored tables and of the file formats."""

from __future__ import annotations

# Column names and types of the stored tables (JSON columns as text).
TABLES = {
    "wiki_pages": "id string, title string, file_path string, notebook string, tags string, aliases string, status string, "
                  "source_type string, source_uri string, revision int, content_hash string, index_status string, "
                  "index_error string, created_at timestamp, updated_at timestamp, deleted_at timestamp",
    "wiki_page_revisions": "id long, page_id string, revision int, title string, content string, metadata string, "
                           "change_summary string, created_at timestamp",
    "wiki_page_links": "id long, source_page_id string, target_page_id string, target_title string",
    "wiki_index_tasks": "id string, page_id string, revision int, action string, status string, attempts int, error string, "
                        "next_attempt_at timestamp, locked_at timestamp, created_at timestamp, updated_at timestamp",
    "agent_pending_actions": "id string, session_id string, plan string, preview string, status string, expires_at timestamp, "
                             "created_at timestamp, updated_at timestamp",
    "external_research_runs": "id string, query string, status string, queries string, draft_title string, draft_content string, "
                              "error string, created_at timestamp, updated_at timestamp",
    "external_sources": "id string, run_id string, title string, url string, snippet string, content string, content_hash string, "
                        "provider string, tool_name string, retrieved_at timestamp, created_at timestamp",
    "wiki_page_sources": "id long, page_id string, source_id string, created_at timestamp",
    "conversations": "id long, session_id string, title string, summary string, summary_message_id long, message_count int, "
                     "created_at timestamp, updated_at timestamp",
    "conversation_messages": "id long, session_id string, role string, content string, intent string, extra_data string, created_at timestamp",
    "agent_runs": "request_id string, session_id string, query string, intent string, status string, execution_time_ms double, "
                  "timeline string, retrieval_stats string, model_usage string, response string, error string, events string, "
                  "runtime_snapshot string, created_at timestamp, updated_at timestamp, completed_at timestamp",
    "answer_feedback": "id string, request_id string, session_id string, category string, status string, question string, "
                       "answer_snapshot string, retrieval_snapshot string, user_note string, target_page_id string, "
                       "write_result string, index_result string, retest_request_id string, retest_answer string, "
                       "retest_snapshot string, error string, created_at timestamp, updated_at timestamp, completed_at timestamp",
    "audios": "id long, filename string, original_filename string, file_path string, file_size long, duration double, "
              "language string, transcription string, transcription_segments string, created_at timestamp",
    "retrieval_settings": "key string, value string, updated_at timestamp",
}

# Typed form of the JSON columns that are queried.
JSON_COLUMNS = {
    "wiki_pages": {"tags": "array<string>", "aliases": "array<string>"},
    "agent_runs": {"timeline": "array<struct<stage:string,status:string,duration_ms:double,error_code:string,message:string>>",
                   "retrieval_stats": "map<string,string>"},
    "audios": {"transcription_segments": "array<struct<start:double,end:double,text:string>>"},
    "external_research_runs": {"queries": "array<string>"},
}

CORPUS = "id string, doc_id string, text string, content string, title string, metadata map<string,string>"
EVIDENCE = ("array<struct<source_id:string,source_sha256:string,raw_source_sha256:string,"
            "start_char:int,end_char:int,quote:string>>")
QUERIES = ("id string, query_id string, query string, category string, question_type string, expected_action string, "
           "relevance map<string,double>, relevant_doc_ids array<string>, reference_answer string, "
           f"reference_claims array<string>, evidence {EVIDENCE}, metadata map<string,string>")
LOGS = ("timestamp string, level string, logger string, request_id string, message string, event string, stage string, "
        "component string, operation string, error_code string, retryable boolean, duration_ms double, status string, "
        "session_id string, run_id string, exception string")
