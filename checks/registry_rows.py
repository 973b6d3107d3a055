"""What the registry must hold, written out: no code of the library is used here.

Fixed values: position, task, category, repo, subset, metrics, available splits, few-shot
split, few-shot rule, generation size, number of stops, evaluation split.
"""

ROWS = [
    (0, "cybermetrics:80", "CyberMetrics", "benchmarks/CyberMetrics", "cyberMetric_80", "loglikelihood", "test", None, None, -1, 0, "test"),
    (1, "cybermetrics:500", "CyberMetrics", "benchmarks/CyberMetrics", "cyberMetric_500", "loglikelihood", "test", None, None, -1, 0, "test"),
    (2, "cybermetrics:2000", "CyberMetrics", "benchmarks/CyberMetrics", "cyberMetric_2000", "loglikelihood", "test", None, None, -1, 0, "test"),
    (3, "cybermetrics:10000", "CyberMetrics", "benchmarks/CyberMetrics", "cyberMetric_10000", "loglikelihood", "test", None, None, -1, 0, "test"),
    (4, "cybermetrics:80_em", "CyberMetrics", "benchmarks/CyberMetrics", "cyberMetric_80", "exact_match,prefix_match,mcq_regex", "test", None, None, 100, 1, "test"),
    (5, "cybermetrics:500_em", "CyberMetrics", "benchmarks/CyberMetrics", "cyberMetric_500", "exact_match,prefix_match,mcq_regex", "test", None, None, 100, 1, "test"),
    (6, "cybermetrics:2000_em", "CyberMetrics", "benchmarks/CyberMetrics", "cyberMetric_2000", "exact_match,prefix_match,mcq_regex", "test", None, None, 100, 1, "test"),
    (7, "cybermetrics:10000_em", "CyberMetrics", "benchmarks/CyberMetrics", "cyberMetric_10000", "exact_match,prefix_match,mcq_regex", "test", None, None, 100, 1, "test"),
    (8, "mmlu:cs_security", "MMLU", "lighteval/mmlu", "computer_security", "exact_match,prefix_match,mcq_regex", "auxiliary_train,test,validation,dev", "dev", None, 5, 1, "test"),
    (9, "cti_bench:cti-mcq", "CTI-Bench", "benchmarks/CTI-Bench", "cti-mcq", "loglikelihood", "validation,test", None, None, -1, 0, "test"),
    (10, "cti_bench:cti-mcq_em", "CTI-Bench", "benchmarks/CTI-Bench", "cti-mcq", "mcq_regex", "validation,test", None, None, 1024, 0, "test"),
    (11, "cti_bench:cti-mcq_em_direct", "CTI-Bench", "benchmarks/CTI-Bench", "cti-mcq", "mcq_regex", "validation,test", None, None, 100, 1, "test"),
    (12, "cti_bench:cti-rcm_em", "CTI-Bench", "benchmarks/CTI-Bench", "cti-rcm", "weakness_id", "validation,test", None, None, 512, 0, "test"),
    (13, "cti_bench:cti-rcm_em_direct", "CTI-Bench", "benchmarks/CTI-Bench", "cti-rcm", "weakness_id", "validation,test", None, None, 100, 1, "test"),
    (14, "cti_bench_ori:cti-mcq", "CTI-Bench (original)", "AI4Sec/cti-bench", "cti-mcq", "loglikelihood", "test", None, None, -1, 0, "test"),
    (15, "cti_bench_ori:cti-mcq_em", "CTI-Bench (original)", "AI4Sec/cti-bench", "cti-mcq", "mcq_regex", "test", None, None, 1024, 0, "test"),
    (16, "cti_bench_ori:cti-mcq_em_direct", "CTI-Bench (original)", "AI4Sec/cti-bench", "cti-mcq", "mcq_regex", "test", None, None, 100, 1, "test"),
    (17, "cti_bench_ori:cti-rcm_em", "CTI-Bench (original)", "AI4Sec/cti-bench", "cti-rcm", "weakness_id", "test", None, None, 512, 0, "test"),
    (18, "cti_bench_ori:cti-rcm_em_direct", "CTI-Bench (original)", "AI4Sec/cti-bench", "cti-rcm", "weakness_id", "test", None, None, 100, 1, "test"),
    (19, "secure:maet", "SECURE", "benchmarks/SECURE", "MAET", "loglikelihood", "val,test", "val", "sequential", -1, 0, "test"),
    (20, "secure:cwet", "SECURE", "benchmarks/SECURE", "CWET", "loglikelihood", "val,test", "val", "sequential", -1, 0, "test"),
    (21, "secure:maet_em", "SECURE", "benchmarks/SECURE", "MAET", "exact_match,prefix_match,mcq_regex", "val,test", "val", "sequential", 100, 1, "test"),
    (22, "secure:cwet_em", "SECURE", "benchmarks/SECURE", "CWET", "exact_match,prefix_match,mcq_regex", "val,test", "val", "sequential", 100, 1, "test"),
    (23, "secure:kcv_em", "SECURE", "benchmarks/SECURE", "KCV", "exact_match,prefix_match", "val,test", "val", "sequential", 100, 1, "test"),
    (24, "secbench:mcq-en", "SecBench", "benchmarks/SecBench", "MCQs_English", "loglikelihood", "val,test", "val", "sequential", -1, 0, "test"),
    (25, "secbench:mcq-en_em", "SecBench", "benchmarks/SecBench", "MCQs_English", "exact_match,prefix_match,mcq_regex", "val,test", "val", "sequential", 100, 1, "test"),
    (26, "seceval:mcqa", "SecEval", "benchmarks/SecEval", "default", "exact_match,prefix_match", "val,test", "val", "sequential", 512, 1, "test"),
    (27, "seceval:mcqa_5s", "SecEval", "benchmarks/SecEval", "default", "exact_match,prefix_match", "val,test", "val", "sequential", 512, 1, "test"),
    (28, "house_mcq:cybersecurity_knowledge_generals", "In-house MCQ", "benchmarks/house_mcq", "cybersecurity_knowledge_generals", "loglikelihood", "test", "val", "sequential", -1, 0, "test"),
    (29, "house_mcq_em:cybersecurity_knowledge_generals", "In-house MCQ", "benchmarks/house_mcq", "cybersecurity_knowledge_generals", "exact_match,prefix_match,mcq_regex", "test", "val", "sequential", 100, 1, "test"),
    (30, "house_mcq:cybersecurity_knowledge_frameworks", "In-house MCQ", "benchmarks/house_mcq", "cybersecurity_knowledge_frameworks", "loglikelihood", "test", "val", "sequential", -1, 0, "test"),
    (31, "house_mcq_em:cybersecurity_knowledge_frameworks", "In-house MCQ", "benchmarks/house_mcq", "cybersecurity_knowledge_frameworks", "exact_match,prefix_match,mcq_regex", "test", "val", "sequential", 100, 1, "test"),
    (32, "house_mcq:cybersecurity_skills", "In-house MCQ", "benchmarks/house_mcq", "cybersecurity_skills", "loglikelihood", "test", "val", "sequential", -1, 0, "test"),
    (33, "house_mcq_em:cybersecurity_skills", "In-house MCQ", "benchmarks/house_mcq", "cybersecurity_skills", "exact_match,prefix_match,mcq_regex", "test", "val", "sequential", 100, 1, "test"),
    (34, "house_mcq:cybersecurity_tools_cli", "In-house MCQ", "benchmarks/house_mcq", "cybersecurity_tools_cli", "loglikelihood", "test", "val", "sequential", -1, 0, "test"),
    (35, "house_mcq_em:cybersecurity_tools_cli", "In-house MCQ", "benchmarks/house_mcq", "cybersecurity_tools_cli", "exact_match,prefix_match,mcq_regex", "test", "val", "sequential", 100, 1, "test"),
    (36, "house_mcq:cybersecurity_tools_kali", "In-house MCQ", "benchmarks/house_mcq", "cybersecurity_tools_kali", "loglikelihood", "test", "val", "sequential", -1, 0, "test"),
    (37, "house_mcq_em:cybersecurity_tools_kali", "In-house MCQ", "benchmarks/house_mcq", "cybersecurity_tools_kali", "exact_match,prefix_match,mcq_regex", "test", "val", "sequential", 100, 1, "test"),
]

#: Suites: name, members, shots.
HOUSE = (
    "cybersecurity_knowledge_generals",
    "cybersecurity_knowledge_frameworks",
    "cybersecurity_skills",
    "cybersecurity_tools_cli",
    "cybersecurity_tools_kali",
)
RELATED = (
    "cti_bench:cti-mcq",
    "cybermetrics:500",
    "mmlu:cs_security",
    "secbench:mcq-en",
    "seceval:mcqa",
    "secure:maet",
    "secure:cwet",
    "secure:kcv_em",
)
SUITES = {
    "house_base": ([f"house_mcq:{s}" for s in HOUSE], 0),
    "house_instruct": ([f"house_mcq_em:{s}" for s in HOUSE], 0),
    "related_base": ([*RELATED, "cti_bench:cti-rcm_em_direct"], 5),
    "related_instruct": ([*RELATED, "cti_bench:cti-rcm_em"], 0),
}

#: Label domains, in the order that gives each label its index.
FOUR = ("A", "B", "C", "D")
THREE = ("T", "F", "X")
SETS = (
    "A", "B", "C", "D", "AB", "AC", "AD", "BC", "BD", "CD",
    "ABC", "ABD", "ACD", "BCD", "ABCD", "",
)
