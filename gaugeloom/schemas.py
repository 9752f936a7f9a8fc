"""Schemas of the record files. All fields are nullable; readers take the superset of old and new fields."""

QUERY = "benchmark_name string, benchmark_part string, task_name string, image_id bigint, file_name string, image_path string, group_id string, prompt_id int, prompt string, options array<string>, option_descriptions map<string,string>, target_answer string, label_vocab array<string>, target_labels array<string>"
EVIDENCE_PREDICTION = "model_name string, task_name string, image_id bigint, group_id string, prompt_id int, target_answer string, target_labels array<string>, prediction_raw string, raw_text string, prediction_parsed string, prediction_labels array<string>, latency_ms int, success boolean, label_vocab array<string>"
TARGET = "struct<instance_id:string,annotation_id:bigint,coarse_part:string,part8:string,bbox_xyxy:array<double>,source_type:string>"
ITEM = (
    "item_id string, person_image struct<image_id:string,path:string,focus:struct<mode:string,bbox_xyxy:array<double>>>, query struct<template_id:string,text:string>, "
    "options array<struct<option_id:string,type:string,path:string,part8:string,coarse_part:string>>, "
    "answer struct<mode:string,correct_option_ids:array<string>,target_coarse_parts:array<string>,target_part8s:array<string>,num_correct:int>, "
    f"meta struct<source:string,subset:string,num_options:int,has_multiple_targets:boolean,target_instances:array<{TARGET}>,missing_option_coarse_parts:array<string>,missing_option_part8s:array<string>,seed:bigint>, "
    "options_grid struct<enabled:boolean,path:string>"
)
PREDICTION = "item_id string, record_id string, model_id string, model_name string, choices array<string>, selected_option_ids array<string>, choice string, raw_text string, raw_output string, parse_error int, latency_ms int, timestamp string"
FREEFORM_ITEM = "record_id string, source_record_id string, pair_id string, image_id bigint, image_path string, group_id string, prompt_id int, variant string, prompt string, canonical_target_set array<string>, gold_count int"
COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, categories array<struct<id:int,name:string>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,segmentation:array<array<double>>,area:double>>"
)
METRICS = "variant string, model_name string, num_samples bigint, raw_num_samples bigint, num_paraphrase_groups bigint, raw_num_paraphrase_groups bigint, consistency_gate_enabled boolean, num_groups_excluded_by_gate bigint, policy_versions map<string,string>, metrics map<string,double>, baseline_name string, artifacts struct<per_item_jsonl:string,per_group_json:string>"
