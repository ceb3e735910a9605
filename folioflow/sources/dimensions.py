"""Small dimension tables: default guidance, drafting profiles, status labels.

All of them are fixed values of a known size (at most a few dozen rows), so joins with them
may broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow import vocab

# --- fixed values: guidance per section type ---------------------------------------------------

SECTION_GUIDANCE = {
    "methodology": "Describe the technical approach: methods, models, datasets, validation strategy, and risk mitigation.",
    "impact_pathway": "Articulate the impact pathway: from outputs to outcomes to wider impacts. Include scientific, economic, and societal dimensions, with measurable indicators.",
    "impact": "Describe the expected impacts: scientific, economic, societal, and policy. Identify target stakeholders and quantify expected benefits where possible.",
    "excellence": "Frame ambition and credibility: state of the art, research questions, novelty, soundness of methodology, interdisciplinary fit.",
    "implementation": "Describe the work plan structure: WPs, tasks, milestones, deliverables, risk register, governance, and consortium fit.",
    "work_plan": "Lay out the WP/task structure with effort allocation, milestones, and a brief Gantt summary. Include dependencies between tasks.",
    "consortium": "Describe the consortium composition: each partner's role, complementarity, and added value.",
    "budget": "Justify the resource allocation: personnel costs, equipment, subcontracting, travel, with rationale per WP.",
    "ethics": "Address ethical considerations: data protection, informed consent, dual use, environmental impact.",
    "dissemination": "Plan dissemination, exploitation, and communication: target audiences, channels, IPR strategy.",
    "other": "Provide a clear, well-structured contribution to this section.",
}

# --- fixed values: drafting profiles -------------------------------------------------------------

PROFILES = {
    "digital_europe": {
        "name": "Digital Europe Programme",
        "terminology": {
            "work_package": "Work Package",
            "technology_readiness": "Maturity Level",
            "deliverable": "Output",
            "milestone": "Checkpoint",
            "dissemination": "Communication and uptake",
            "impact_pathway": "Results pathway",
            "key_performance_indicator": "Performance indicator",
        },
        "section_guidance": {
            "methodology": "Describe the technical approach and implementation methodology. Focus on: digital technologies and tools to be deployed, integration with existing systems, scalability and interoperability, cybersecurity measures, and validation approach. Emphasize practical deployment over research novelty.",
            "impact": "Describe expected impacts on digital capacity, competitiveness, and resilience. Cover: economic benefits (job creation, market growth), societal benefits (digital inclusion, skills development), and strategic autonomy. Quantify impacts where possible and align with DEP objectives.",
            "implementation": "Describe the implementation plan with work packages, activities, and timeline. Include resource allocation, governance structure, quality assurance measures, and risk management. Emphasize operational readiness and deployment capacity.",
            "work_plan": "Detail the work package structure with activities, timeline, and dependencies. Include a deployment roadmap, checkpoints for progress verification, and outputs with delivery dates. Show how activities build digital capacity incrementally.",
            "consortium": "Describe consortium composition and operational capacity. For each partner: explain their role, technical expertise, deployment experience, and contribution to project objectives. Demonstrate capacity to deliver at scale.",
            "dissemination": "Plan communication, uptake, and sustainability activities. Cover: target user groups and engagement strategy, training and capacity building, technology transfer and adoption measures, and post-project sustainability plan.",
        },
        "expected_outputs": {
            "implementation": [
                "Work package structure with activities",
                "Resource allocation plan",
                "Deployment roadmap",
                "Checkpoint list with verification criteria",
                "Output list with delivery dates",
                "Risk register with contingency plans",
                "Governance and coordination structure",
            ],
            "work_plan": [
                "Work package breakdown with activity descriptions",
                "Deployment timeline and roadmap",
                "Checkpoint table",
                "Output table with acceptance criteria",
                "Dependency analysis",
            ],
            "consortium": [
                "Partner roles and capabilities matrix",
                "Deployment capacity assessment",
                "Technical expertise coverage",
            ],
            "dissemination": [
                "Communication plan with target audiences",
                "Training and capacity building programme",
                "Technology adoption strategy",
                "Sustainability and exploitation plan",
            ],
            "impact": [
                "Performance indicator table with targets",
                "Economic impact assessment",
                "Digital capacity building metrics",
                "Alignment with DEP strategic objectives",
            ],
        },
    },
    "horizon_europe": {
        "name": "Horizon Europe Standard",
        "terminology": {
            "work_package": "WP",
            "technology_readiness": "TRL",
            "deliverable": "Deliverable",
            "milestone": "Milestone",
            "dissemination": "Dissemination and exploitation",
            "impact_pathway": "Impact pathway",
            "key_performance_indicator": "KPI",
        },
        "section_guidance": {
            "methodology": "Describe the overall methodology and technical approach. Include: research methods, models and frameworks, datasets and validation strategy, risk mitigation measures, and how the approach addresses the call's specific challenges. Reference TRL progression where applicable.",
            "impact_pathway": "Articulate the impact pathway from project outputs to outcomes to wider impacts. Cover scientific, economic, societal, and policy dimensions. Include measurable KPIs and explain how impacts align with the call's expected outcomes and EU policy priorities.",
            "impact": "Describe expected impacts across scientific, economic, societal, and policy dimensions. Identify target stakeholders and beneficiaries. Quantify expected benefits where possible and explain alignment with EU strategic priorities and SDGs.",
            "excellence": "Demonstrate excellence through: state of the art and research gap analysis, clear research questions and objectives, novelty and ambition of the approach, soundness of methodology, and interdisciplinary integration where relevant.",
            "implementation": "Describe the work plan structure with WPs, tasks, milestones, and deliverables. Include effort allocation (person-months per partner per WP), Gantt chart, risk register with mitigation measures, governance structure, and consortium complementarity.",
            "work_plan": "Detail the WP structure with objectives, tasks, effort allocation, and interdependencies. Include a Gantt chart showing timeline and critical path. List milestones (verification points) and deliverables (tangible outputs) with clear success criteria.",
            "consortium": "Describe consortium composition and complementarity. For each partner: explain their role, relevant expertise, added value, and contribution to project objectives. Demonstrate that the consortium has the necessary competences and no critical gaps.",
            "dissemination": "Plan dissemination, exploitation, and communication activities. Cover: target audiences and channels, open science practices (open access, FAIR data), IPR management and exploitation strategy, and measures to maximize impact and uptake.",
        },
        "expected_outputs": {
            "implementation": [
                "WP structure with objectives and tasks",
                "Effort allocation table (person-months per partner per WP)",
                "Gantt chart",
                "Milestone list with verification criteria",
                "Deliverable list with due dates",
                "Risk register with mitigation measures",
                "Governance and decision-making structure",
            ],
            "work_plan": [
                "WP breakdown with task descriptions",
                "Gantt chart showing timeline and dependencies",
                "Milestone table",
                "Deliverable table",
                "Critical path analysis",
            ],
            "consortium": [
                "Partner roles and responsibilities matrix",
                "Complementarity analysis",
                "Competence coverage map",
            ],
            "dissemination": [
                "Dissemination plan with target audiences",
                "Open science and FAIR data strategy",
                "IPR management plan",
                "Exploitation roadmap",
                "Communication activities timeline",
            ],
            "impact_pathway": [
                "Logic model (outputs → outcomes → impacts)",
                "KPI table with baselines and targets",
                "Stakeholder engagement plan",
                "Alignment with EU policy priorities",
            ],
        },
    },
}


def default_guidance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(SECTION_GUIDANCE.items()), "section_type string, guidance string"
    )


def profile_guidance(spark: SparkSession) -> DataFrame:
    """(programme, profile_name, section_type, guidance?, expected_outputs) per profile section."""
    rows = []
    for programme, p in sorted(PROFILES.items()):
        for section in vocab.SECTION_TYPES:
            rows.append(
                (
                    programme,
                    p["name"],
                    section,
                    p["section_guidance"].get(section),
                    p["expected_outputs"].get(section, []),
                )
            )
    return spark.createDataFrame(
        rows,
        "programme string, profile_name string, section_type string, "
        "profile_guidance string, expected_outputs array<string>",
    )


def terminology(spark: SparkSession) -> DataFrame:
    rows = [
        (programme, term, preferred)
        for programme, p in sorted(PROFILES.items())
        for term, preferred in p["terminology"].items()
    ]
    return spark.createDataFrame(rows, "programme string, term string, preferred string")


def available_profiles() -> list[str]:
    return sorted(PROFILES)


def status_labels(spark: SparkSession) -> DataFrame:
    rows = [
        (s, vocab.STATUS_LABEL[s], vocab.STATUS_BADGE[s], vocab.STATUS_CAVEAT[s])
        for s in vocab.SOURCE_STATUSES
    ]
    return spark.createDataFrame(
        rows, "source_status string, label string, badge string, caveat string"
    )
