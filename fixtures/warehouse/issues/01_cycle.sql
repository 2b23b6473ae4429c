INSERT INTO tmp.loop_a SELECT k FROM tmp.loop_b;
INSERT INTO tmp.loop_b SELECT k FROM tmp.loop_a;
