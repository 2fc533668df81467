"""Prompt and name functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt templates.
SKELETON_HEAD = "You're an organizer responsible for only giving the skeleton (not the full content) for answering the question. Provide the skeleton in a list of points (numbered 1., 2., 3., etc.) to answer the question. Instead of writing a full sentence, each skeleton point should be very short with only 3~5 words. Generally, the skeleton should have 3~10 points.\n\nQuestion:\nWhat are the typical types of Chinese dishes?\nSkeleton:\n1. Dumplings. \n2. Noodles. \n3. Dim Sum. \n4. Hot Pot. \n5. Wonton. \n6. Ma Po Tofu. \n7. Char Siu. \n8. Fried Rice. \n\nQuestion:\nWhat are some practical tips for individuals to reduce their carbon emissions?\nSkeleton:\n1. Energy conservation. \n2. Efficient transportation. \n3. Home energy efficiency. \n4. Reduce water consumption. \n5. Sustainable diet. \n6. Sustainable travel. \n\nNow, please provide the skeleton for the following question.\n"
SKELETON_TAIL = "\nSkeleton:\n "
PREFIX_PARTS = (
    "[INST] You're responsible for continuing the writing of one and only one point in the overall answer to the following question.\n\n",
    "\n\nThe skeleton of the answer is\n\n",
    "\n\n Write it **very shortly** in 1~2 sentence and do not continue with other points! Continue and only continue the writing of point ",
)
POINT_MARK = ". [/INST]"


def skeleton_prompt(question: Column) -> Column:
    return F.concat(F.lit(SKELETON_HEAD), question, F.lit(SKELETON_TAIL))


def shared_prefix(question: Column, skeleton: Column) -> Column:
    a, b, c = map(F.lit, PREFIX_PARTS)
    return F.concat(a, question, b, skeleton, c)


def point_prompt(index: Column, line: Column) -> Column:
    """index: 0-based place of the line, which numbers the prompt whatever number the line has itself."""
    return F.concat((index + 1).cast("string"), F.lit(POINT_MARK), line)


def normalised_skeleton(answer: Column) -> Column:
    """Each line without leading white space; lines as in universal splitting, a last line end adds none."""
    ends = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
    lines = F.split(F.regexp_replace(answer, f"(?:{ends})$", ""), ends)
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^[\s\x0B\x1C-\x1F\x85 ]+", "")), "\n")


def tree_name(model: Column) -> Column:
    """The candidate tree for a model's name; other names get the default tree."""
    has = model.contains
    sized = F.when(has("7b"), "vicuna_7b_stage2").when(has("13b"), "vicuna_13b_stage2").when(has("33b"), "vicuna_33b_stage2").otherwise("mc_sim_7b_63")
    return F.when(has("vicuna"), sized).when(has("zephyr"), "zephyr_stage2").otherwise("mc_sim_7b_63")


def stage_file(kind: Column, world: Column, rank: Column) -> Column:
    return F.format_string("temp_%s_world_%s_rank_%s/stage.bin", kind, world.cast("string"), rank.cast("string"))


def model_type(name: Column) -> Column:
    return F.when(name.contains("vicuna_7b"), F.lit("vicuna_7b")).otherwise(F.raise_error(F.concat(F.lit("unsupported model "), name)).cast("string"))
