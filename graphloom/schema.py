"""Spark schemas of the data model."""

from __future__ import annotations

RECORD = "id string, subject_id string, module_id string, module_title string, book_title string, section string, text string, key_terms array<string>, learning_objectives array<string>, attribution string, license string, license_url string, source string"
CONCEPT = "name string, type string, definition string, key_term boolean, frequency long, importance_score double, source_modules array<string>, aliases array<string>"
MODULE = "module_id string, title string, key_terms array<string>"
SECTION = "section_id string, title string, module_id string, learning_objectives array<string>"
CHUNK = "chunk_id string, text string, chunk_index long, start_char long, end_char long, module_id string, section string, text_embedding array<float>, previous_chunk_id string, next_chunk_id string"
EDGE = "source string, target string, type string, weight double, confidence double, evidence string"
EDGE_TYPES = ("PREREQ", "RELATED", "COVERS", "PART_OF", "MENTIONS", "NEXT", "FIRST_CHUNK")
MASTERY = "concept_name string, mastery_level double, attempts long, correct_attempts long, last_assessed timestamp_ntz, bkt_p_known double, p_transit double, p_slip double, p_guess double"
PROFILE = f"student_id string, mastery_map map<string, struct<{MASTERY}>>, overall_ability double, created_at timestamp_ntz, updated_at timestamp_ntz"
QUIZ = "struct<questions: array<struct<text: string, options: array<struct<id: string, text: string>>, correct_option_id: string, explanation: string, difficulty: string, difficulty_score: double>>>"
