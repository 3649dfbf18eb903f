"""Explicit schemas of the files the engine reads."""

from __future__ import annotations

USAGE = "modelCalls:bigint,tokensIn:bigint,tokensOut:bigint,costUsd:double,models:array<string>"
STAGE = "struct<name:string,module:string,version:string,policy:string,mode:string,findings:array<string>,decision:string>"
TRACE = f"struct<source:string,transformedSource:string,rawOutput:string,releasedOutput:string,stages:array<{STAGE}>>"
RUN = f"struct<caseId:string,system:string,repetition:int,output:string,latencyMs:bigint,error:string,{USAGE},modelRequests:array<string>,trace:{TRACE}>"
GRADE = "struct<grader:string,pass:boolean,score:double,extracted:string,detail:string>"
RECORD = f"run {RUN}, grades array<{GRADE}>, judge struct<{USAGE}>, status string"

DOCS = "array<struct<title:string,text:string>>"
PUBLIC_CASE = f"id string, suite string, task string, instructions string, input string, docs {DOCS}, examples array<struct<q:string,a:string>>, question string, choices array<string>, _source string"
PRIVATE_CASE = "id string, graders array<string>, answer string, qaPairs array<struct<question:string,shortAnswers:array<string>>>, clauses array<struct<text:string,passages:array<int>>>, protected array<string>"
HARNESS = "name string, entry string, description string, suites array<string>, models map<string,string>, providers map<string,struct<baseUrl:string,keyEnv:string>>, maxCalls bigint, image string, imageEntry string, dockerfile string"
BENCHMARK = "name string, graders array<string>, judge struct<model:string>"
CONTRACTS = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"
RETRIEVAL = f"question string, docs {DOCS}, qa_pairs array<struct<question:string,short_answers:array<string>>>"
