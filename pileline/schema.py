"""Schemas of inputs and outputs as DDL."""

READS = "read_idx bigint, read_id string, seq string, qual string, hit int, ab string, read_len int, strand string, chr string, pos bigint, mismatch int, indel_pos int"
GENOME_BLOCKS = "chr string, block bigint, start bigint, seq string"
DBSNP = "chr string, pos bigint, hapmap int, validated int, indel int, f_a double, f_c double, f_t double, f_g double, rsid string"
REGIONS = "chr string, start bigint, end bigint"
P_MATRIX = "q int, cycle int, t_base int, o_base int, p double"
CONSENSUS = (
    "chr string, pos bigint, ref string, genotype string, quality int, base1 string, avg_q1 bigint, uni1 bigint, all1 bigint, "
    "base2 string, avg_q2 bigint, uni2 bigint, all2 bigint, depth bigint, rank_p double, copy_number double, is_dbsnp int"
)
