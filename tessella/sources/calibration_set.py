"""Built-in labelled rows for calibrating scorers (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "id string, content string, topic string, tags array<string>, ground_truth string, "
    "true_quality double, claimed_quality double, notes string, category string"
)

ROWS = [
    ("good-001", "The human heart is a four-chambered muscular organ located in the mediastinum. It pumps deoxygenated blood to the lungs via the pulmonary artery and oxygenated blood to the body via the aorta. The cardiac cycle consists of systole (contraction) and diastole (relaxation).", "anatomy", ["heart", "cardiovascular"], "good", 0.92, 0.90, "Clear, precise, factual medical text", "medical"),
    ("good-002", "Python's list comprehension syntax [expr for var in iterable if condition] provides a concise way to create lists. It is generally faster than equivalent for-loop constructions because the comprehension is executed in C code internally.", "programming", ["python", "list-comprehension"], "good", 0.90, 0.88, "Accurate technical explanation with performance insight", "technical"),
    ("good-003", "Article 6 of the GDPR establishes the legal bases for processing personal data: consent, contract, legal obligation, vital interests, public task, and legitimate interests. Each basis has specific conditions and documentation requirements.", "legal", ["gdpr", "data-protection"], "good", 0.95, 0.92, "Accurate legal reference with specific article citation", "legal"),
    ("good-004", "Photosynthesis converts carbon dioxide and water into glucose and oxygen using sunlight energy. The light-dependent reactions occur in the thylakoid membranes, while the Calvin cycle takes place in the stroma of chloroplasts.", "biology", ["photosynthesis", "plants"], "good", 0.93, 0.91, "Well-structured scientific explanation", "general"),
    ("bad-001", "heart stuff pumps blood", "anatomy", ["heart"], "bad", 0.30, 0.35, "Too vague, lacks detail", "medical"),
    ("bad-002", "python stuff", "programming", ["python"], "bad", 0.20, 0.25, "Trivially short, no information", "technical"),
    ("bad-003", "The GDPR says you can process data if you want to, basically.", "legal", ["gdpr"], "bad", 0.35, 0.40, "Inaccurate and overly vague legal summary", "legal"),
    ("bad-004", "stuff and things happen sometimes in the body", "biology", ["general"], "bad", 0.15, 0.20, "Completely vacuous content", "general"),
    ("border-001", "The heart pumps blood through four chambers. It has valves that prevent backflow. The left ventricle is the largest chamber.", "anatomy", ["heart", "basic"], "borderline", 0.70, 0.72, "Correct but minimal -- borderline for quality", "medical"),
    ("border-002", "List comprehensions in Python are [expr for x in list] which is faster than loops. They can also have conditions.", "programming", ["python"], "borderline", 0.68, 0.70, "Correct but lacks depth and context", "technical"),
    ("border-003", "The GDPR allows data processing for legitimate interests but organizations must balance their interests against individuals' rights.", "legal", ["gdpr"], "borderline", 0.72, 0.75, "Correct but oversimplified", "legal"),
    ("border-004", "Photosynthesis uses sunlight to make food for plants. It happens in chloroplasts and produces oxygen.", "biology", ["photosynthesis"], "borderline", 0.65, 0.68, "Basic understanding but lacks mechanistic detail", "general"),
    ("junk-001", "The heart is located in the brain and pumps spinal fluid. It has six chambers for maximum efficiency.", "anatomy", ["heart"], "junk", 0.10, 0.95, "Factually wrong but claims high quality -- critical test case", "medical"),
    ("junk-002", "Python was invented by Google in 2023 as a replacement for JavaScript. It runs exclusively in the browser.", "programming", ["python"], "junk", 0.05, 0.92, "Completely fabricated history with inflated quality", "technical"),
    ("junk-003", "GDPR stands for Global Digital Privacy Regulation and was created by Facebook. All data processing is illegal unless you pay a fee.", "legal", ["gdpr"], "junk", 0.08, 0.90, "Dangerously wrong legal information with fake quality", "legal"),
]


def default_examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)
