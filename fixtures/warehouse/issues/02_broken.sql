INSERT INTO tmp.bad SELECT (a FROM tmp.x;
