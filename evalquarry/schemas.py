"""Explicit schemas of generation records, run documents and metric rows."""

from __future__ import annotations

import dataclasses
import typing

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBLEM = "id string, problem string, answer string, source string, domain string, llama8b_solve_rate string, label string"
PROBLEM_24 = "id string, problem string, answer array<bigint>, solutions array<string>, compute_graph array<array<array<string>>>, numbers array<bigint>, source string, domain string, label string"
PROBLEM_CODE = PROBLEM + ", mode string, code string, input string, output string"
GENERATION = "struct<response_id:bigint,generated_response:string,finish_reason:string,extracted_answer:string,correctness:boolean>"
METADATA = "struct<num_responses:bigint,n_samples_requested:bigint,n_samples_variant_default:bigint,template_path:string,template_key:string,model_config_alias:string,prompt_hash:string>"
STAT_NAME = "struct<name:string,split:string,sub_split:string,perturbation:struct<name:string,computed_on:string,robustness:boolean,fairness:boolean,prob:double>>"
STAT_NUMBERS = "count bigint, sum double, sum_squared double, min double, max double, mean double, variance double, stddev double"
STAT = f"struct<name:{STAT_NAME},{STAT_NUMBERS.replace(', ', ',').replace(' ', ':')}>"
RUN_SPEC = "name string, scenario_spec struct<class_name:string,args:map<string,string>>, adapter_spec struct<method:string,model:string,model_deployment:string>"
SCENARIO_STATE = "adapter_spec struct<method:string,model:string>, request_states array<struct<instance:struct<id:string,split:string,input:struct<text:string>,perturbation:struct<name:string>>,train_trial_index:bigint,request:struct<model:string,prompt:string>,result:struct<success:boolean,completions:array<struct<text:string,logprob:double>>>>>"
PER_INSTANCE = f"instance_id string, train_trial_index bigint, perturbation struct<name:string>, stats array<{STAT}>"
RESULT = "result struct<acc_clean:double,acc_2f:double,drag:double,n_kept_problems:bigint,aggregate_failed:boolean,model_config:string,data_path:string>"
VERDICT = "status string, output string, symbols map<string,string>, timestamp string"


def packed(task: str, problem: str = PROBLEM) -> str:
    """DDL of a packed generation record of one task."""
    return f"{problem}, {task}_prompt string, {task}_generations array<{GENERATION}>, {task}_generations_metadata {METADATA}"


_KINDS = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def type_of(hint: object) -> T.DataType:
    """JSN2: the Spark type of a type hint: scalars, dataclasses, lists, dictionaries by text, and optional ones of these."""
    if hint in _KINDS:
        return _KINDS[hint]
    if dataclasses.is_dataclass(hint):
        return struct_of(hint)
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (list, tuple):
        return T.ArrayType(type_of(args[0]))
    if origin is dict:
        return T.MapType(type_of(args[0]), type_of(args[1]))
    rest = [a for a in args if a is not type(None)]
    if len(rest) == 1 and len(args) == 2:
        return type_of(rest[0])
    raise TypeError(f"no type for {hint}")


def struct_of(cls: type) -> T.StructType:
    """JSN2: the struct type of a dataclass, at any depth."""
    hints = typing.get_type_hints(cls)
    return T.StructType([T.StructField(f.name, type_of(hints[f.name])) for f in dataclasses.fields(cls)])


def decode(c: Column, cls: type, strict: bool = False) -> Column:
    """JSN2: JSON text as the struct of a dataclass; malformed text is null, or raises if ``strict``."""
    return F.from_json(c, struct_of(cls), {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def encode(c: Column) -> Column:
    """JSN2: a struct as JSON text; null fields are left out."""
    return F.to_json(c)


class Registry:
    """JSN2: dataclasses by name, so that a column that names its class can be decoded."""

    def __init__(self, *classes: type) -> None:
        self.classes = {c.__name__: c for c in classes}

    def decode(self, kind: str, c: Column) -> Column:
        if kind not in self.classes:
            raise KeyError(f"unknown class {kind}; there are {sorted(self.classes)}")
        return decode(c, self.classes[kind])
